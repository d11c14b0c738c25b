"""A small retail star under its own column names, clean or with every defect at once."""

from __future__ import annotations

import random
from datetime import date, timedelta
from decimal import Decimal

SCHEMAS = {
    "dim_customer": "customer_id bigint, customer_number string, first_name string, "
    "last_name string, full_name string, gender string, marital_status string, birthdate date, "
    "age int, age_group string, city string, country string, continent string",
    "dim_product": "product_id bigint, product_number string, product_name string, "
    "cost decimal(18,2), product_line string, category string, subcategory string, "
    "maintenance_required string",
    "dim_store": "store_id bigint, store_name string, store_type string, region string",
    "fact_sales": "order_number string, product_id bigint, customer_id bigint, store_id bigint, "
    "order_date date, shipping_date date, due_date date, order_year int, order_month int, "
    "order_month_name string, quantity int, price decimal(18,2), sales_amount decimal(18,2), "
    "days_to_ship int, days_to_due int, delivery_status string",
    "fact_returns": "return_id string, order_number string, return_date date, return_year int, "
    "return_month int, return_reason string, return_amount decimal(18,2)",
}

PLACES = [
    ("Paris", "France", "Europe"),
    ("Lyon", "France", "Europe"),
    ("Tokyo", "Japan", "Asia"),
    ("Lima", "Peru", "Latin America"),
]


def group_of(age):
    if age is None:
        return "Unknown"
    return "Under 20" if age < 20 else f"{age // 10 * 10}-{age // 10 * 10 + 9}"


def customers(rnd, n):
    rows = []
    for i in range(1, n + 1):
        age = rnd.choice([None, 16, 19, 25, 34, 47, 52, 101, *range(20, 60, 7)])
        born = None if age is None else date(2024 - age, 6, 1)
        city, country, continent = rnd.choice(PLACES)
        name = (f"F{i % 9}", f"L{i % 7}")
        gender = rnd.choice(["Male", "Female", "Unknown", "male", "M "])
        status = rnd.choice(["Married", "Single", "Divorced", None])
        rows.append(
            (i, f"C{i}", *name, " ".join(name), gender, status, born, age, group_of(age))
            + (city, country, continent)
        )
    return rows


def products(rnd, n):
    rows = []
    for i in range(1, n + 1):
        category = ["Bikes", "Accessories", "Clothing", "Components"][i % 4]
        cost = None if i % 11 == 0 else Decimal(rnd.randint(100, 99999)) / 100
        rows.append(
            (i, f"P{i}", f"name {i % 17}", cost, rnd.choice(["Road", "Touring", None]))
            + (category, f"sub {i % 3}", rnd.choice(["Yes", "No"]))
        )
    return rows


def stores(rnd, n):
    kinds = ["Flagship", "Retail", "Online", "Outlet"]
    return [(i, f"store {i % 10}", kinds[i % 4], rnd.choice("NS")) for i in range(1, n + 1)]


def sale(rnd, number, customer, product, store):
    day = date(2023, 1, 1) + timedelta(days=rnd.randint(0, 729))
    ship = rnd.choice([None, *range(0, 12)])
    due = day + timedelta(days=rnd.choice([5, 7, 10]))
    shipped = None if ship is None else day + timedelta(days=ship)
    status = "Unknown" if ship is None else "On Time" if shipped <= due else "Late"
    units = rnd.choice([None, 1, 2, 3, 5])
    # Few distinct amounts: revenues tie. Some cents land averages on a half.
    amount = rnd.choice([None, Decimal("0.01"), Decimal("0.02"), *[Decimal(50 * k) for k in range(6)]])
    price = None if units is None or amount is None else round(amount / units, 2)
    return (number, product, customer, store, day, shipped, due, day.year, day.month) + (
        day.strftime("%B"), units, price, amount, ship, (due - day).days, status)


def give_back(rnd, number, order):
    day = date(2023, 1, 1) + timedelta(days=rnd.randint(0, 729))
    reason = rnd.choice(["Defective", "Size Mismatch", "Unsatisfied", "Wrong Item", "other"])
    amount = rnd.choice([None, Decimal("0.01"), Decimal("12.35"), Decimal(40)])
    return (number, order, day, day.year, day.month, reason, amount)


def tables(kind: str) -> dict[str, list[tuple]]:
    """The five tables.

    ``clean``; ``dirty``: NULL and repeated keys, orphans, fan-out; ``dirty_facts`` and
    ``dirty_dims``: only there; ``one`` row each; ``empty``.
    """
    if kind == "empty":
        return {name: [] for name in SCHEMAS}
    rnd = random.Random(7)
    n = 1 if kind == "one" else 60
    people, goods, shops = customers(rnd, n), products(rnd, max(1, n // 2)), stores(rnd, max(1, n // 5))
    sold, returned = [], []
    for i in range(1, n * 6 + 1 if n > 1 else 2):
        # A third of all sales belong to customer 1; the last ten customers buy nothing.
        buyer = 1 if i % 3 == 0 or n == 1 else rnd.randint(1, n - 10)
        sold.append(
            sale(rnd, f"SO{i}", buyer, rnd.randint(1, len(goods)), rnd.randint(1, len(shops)))
        )
    for i in range(1, len(sold) // 2 + 2):
        # A third of all returns are for one order.
        order = "SO1" if i % 3 == 0 else f"SO{rnd.randint(1, len(sold))}"
        returned.append(give_back(rnd, f"R{i}", order))
    if kind in ("dirty", "dirty_dims"):
        people += [(None, *people[0][1:]), (2, *people[7][1:]), (3, *people[8][1:])]
        goods += [(None, *goods[0][1:]), (4, *goods[9][1:])]
        shops += [(None, *shops[0][1:]), (2, *shops[3][1:])]
        # The busiest customer and product many times over, some copies alike.
        people += [people[0]] * 20 + [(1, *people[5][1:])] * 10
        goods += [goods[2]] * 15
    if kind in ("dirty", "dirty_facts"):
        sold += [
            sale(rnd, "SO5", 4, 4, 2),
            sale(rnd, "SO5", 9, 3, 1),
            sale(rnd, None, 2, 4, 3),
            sale(rnd, None, 2, 5, 3),
            sale(rnd, "SX1", None, None, None),
            sale(rnd, "SX2", 999, 999, 999),
        ]
        returned += [
            give_back(rnd, "R1", "SO9"),
            give_back(rnd, None, "SO9"),
            give_back(rnd, "RX", None),
            give_back(rnd, "RY", "nowhere"),
        ]
        sold += [sale(rnd, "SO1", rnd.randint(1, 20), 3, 1) for _ in range(40)]
        returned += returned[:30]
    return {
        "dim_customer": people,
        "dim_product": goods,
        "dim_store": shops,
        "fact_sales": sold,
        "fact_returns": returned,
    }


def frames(spark, kind: str):
    return {name: spark.createDataFrame(rows, SCHEMAS[name]) for name, rows in tables(kind).items()}


def database(con, dfs) -> None:
    """The same tables in DuckDB, whole numbers widened as the statements show them."""
    for name, df in dfs.items():
        arrow = df.toArrow()
        con.register("incoming", arrow)
        con.sql(f"CREATE TABLE {name} AS SELECT * FROM incoming")
        con.unregister("incoming")

"""Phase 5: how much, along every dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldpan.functions import mean
from goldpan.operators.domain import with_share
from goldpan.operators.magnitudes import Metric, by_attributes, by_dimension, by_groupings
from goldpan.plans.star import KEYS, Star

UNITS = Metric("units_sold", "sum", "quantity")
REVENUE = Metric("total_revenue", "sum", "sales_amount")
PRICED = Metric("priced_lines", "count", "sales_amount")

ORDERS = "total_orders"
AVERAGE = "avg_order_value"
MONTH = ["order_year", "order_month", "order_month_name"]


def distinct_keys(star: Star, counted: str, name: str, *joined: str) -> Metric:
    """COUNT(DISTINCT key) of an object, by the cheapest expression proven equal to it.

    Keys that never repeat, joined to members that never repeat, need no distinct
    count, and where none is NULL the key column need not be read at all.
    """
    if not star.unique(counted, *joined):
        return Metric(name, "distinct", KEYS[counted])
    return Metric(name, "count", "*" if star.proof(counted).complete else KEYS[counted])


def members(star: Star, dim: str, name: str) -> Metric:
    return Metric(name, "count" if star.unique(dim) else "distinct", KEYS[dim])


def with_average(groups: DataFrame, revenue: str = REVENUE.name) -> DataFrame:
    return groups.withColumn(AVERAGE, mean(revenue, PRICED.name)).drop(PRICED.name)


def sales_by(
    star: Star, dim: str, by: list[str], *metrics: Metric, orders: bool = True, **options
) -> DataFrame:
    """Sales metrics by attributes of one dimension, led by the number of orders."""
    if orders:
        metrics = (distinct_keys(star, "fact_sales", ORDERS, dim), *metrics)
    return by_dimension(star.fact_sales, star.gold[dim], KEYS[dim], by, metrics, **options)


def sales_by_own(star: Star, by: list[str], *metrics: Metric) -> DataFrame:
    return by_attributes(star.fact_sales, by, [distinct_keys(star, "fact_sales", ORDERS), *metrics])


def by_year(star: Star) -> DataFrame:
    units = Metric("total_units_sold", "sum", "quantity")
    years = sales_by_own(star, ["order_year"], units, REVENUE, PRICED)
    return with_average(years).orderBy("order_year")


def by_category(star: Star) -> DataFrame:
    groups = sales_by(star, "dim_product", ["category"], UNITS, REVENUE)
    shared = with_share(groups, REVENUE.name, "revenue_pct", star.rows("dim_product"))
    return shared.orderBy(F.desc(REVENUE.name), "category")


def by_store_type(star: Star) -> DataFrame:
    groups = with_average(sales_by(star, "dim_store", ["store_type"], UNITS, REVENUE, PRICED))
    shared = with_share(groups, REVENUE.name, "revenue_pct", star.rows("dim_store"))
    return shared.orderBy(F.desc(REVENUE.name), "store_type")


def by_continent(star: Star) -> DataFrame:
    dim = "dim_customer"
    counted = members(star, dim, "unique_customers")
    groups = sales_by(star, dim, ["continent"], REVENUE, members=counted)
    shared = with_share(groups, REVENUE.name, "revenue_pct", star.rows(dim))
    return shared.orderBy(F.desc(REVENUE.name), "continent")


def by_country(star: Star) -> DataFrame:
    dim, by = "dim_customer", ["country", "continent"]
    counted = members(star, dim, "unique_customers")
    groups = sales_by(star, dim, by, REVENUE, PRICED, members=counted)
    return with_average(groups).orderBy(F.desc(REVENUE.name), *by)


def returns_by_category(star: Star) -> DataFrame:
    """Returns reach their product through the order they belong to.

    They are summed per order first: however many returns one order has, the two
    facts meet one row to one.
    """
    returns = Metric("total_returns", "count", "return_id")
    value = Metric("total_returned_value", "sum", "return_amount")
    valued = Metric("valued", "count", "return_amount")
    metrics = [returns, value, valued]
    per_order = by_attributes(star.fact_returns, ["order_number"], metrics)
    returned = star.fact_sales.select("order_number", "product_id").join(per_order, "order_number")
    sums = [Metric(m.name, "sum", m.name) for m in metrics]
    groups = by_dimension(returned, star.dim_product, "product_id", ["category"], sums)
    average = mean(value.name, valued.name).alias("avg_return_amount")
    groups = groups.select("category", returns.name, value.name, average)
    shared = with_share(groups, value.name, "return_value_pct", star.rows("dim_product"))
    return shared.orderBy(F.desc(returns.name), "category")


def by_segment(
    star: Star, column: str, average: bool = True, year: int | None = None
) -> DataFrame:
    """Customers, orders and revenue per customer attribute, inactive customers included.

    ``year`` restricts the sales that are matched, not the customers.
    """
    dim = "dim_customer"
    fact = star.fact_sales if year is None else star.fact_sales.where(f"order_year = {year}")
    metrics = [distinct_keys(star, "fact_sales", ORDERS, dim), REVENUE]
    groups = by_dimension(
        fact,
        star.dim_customer,
        KEYS[dim],
        [column],
        [*metrics, PRICED] if average else metrics,
        how="left",
        members=members(star, dim, "customer_count"),
    )
    groups = with_average(groups) if average else groups
    return groups.orderBy(F.desc(REVENUE.name), column)


def monthly_trend(star: Star) -> DataFrame:
    revenue = Metric("monthly_revenue", "sum", "sales_amount")
    return sales_by_own(star, MONTH, UNITS, revenue).orderBy(*MONTH)


def customer_groupings(star: Star) -> DataFrame:
    """Customers, orders and revenue by every customer attribute, all from one scan of sales."""
    roles, dim = star.roles, "dim_customer"
    groupings = {
        "continent": ["continent"],
        "country": ["country", "continent"],
        "age group": [roles.age_group],
        "gender": [roles.gender],
        "marital status": [roles.marital_status],
    }
    metrics = [distinct_keys(star, "fact_sales", ORDERS, dim), REVENUE, PRICED]
    counted = members(star, dim, "customer_count")
    found = by_groupings(
        star.fact_sales, star.dim_customer, KEYS[dim], groupings, metrics, counted, "active_customers"
    )
    return with_average(found).orderBy("grouping", F.desc(REVENUE.name), *found.columns[1:6])

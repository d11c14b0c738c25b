"""Phase 6: who ranks where."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldpan.functions import half_up
from goldpan.operators.domain import one_spelling
from goldpan.operators.magnitudes import Metric, by_attributes, by_dimension
from goldpan.operators.ranking import (
    best_per_group,
    leaderboard,
    settled,
    with_percent_rank,
    with_rank,
)
from goldpan.plans.magnitudes import (
    AVERAGE,
    MONTH,
    ORDERS,
    PRICED,
    REVENUE,
    UNITS,
    distinct_keys,
    sales_by,
    sales_by_own,
    with_average,
)
from goldpan.plans.star import Star

PRODUCT = ["product_name", "category", "subcategory"]
STORE = ["store_name", "store_type", "region"]

# A calendar date has a four-digit year.
MAX_MONTHS = 12 * 9999


def product_board(
    star: Star, descending: bool, rank: str, by_key: bool = False, method: str = "dense_rank"
) -> DataFrame:
    """Ten products by revenue; same-named products count as one unless ``by_key``."""
    by = ["product_id", *PRODUCT] if by_key else PRODUCT
    groups = sales_by(star, "dim_product", by, UNITS, REVENUE, orders=False)
    return leaderboard(groups, REVENUE.name, 10, rank, by, descending, method)


def best_products(star: Star) -> DataFrame:
    return product_board(star, True, "revenue_rank")


def worst_products(star: Star) -> DataFrame:
    return product_board(star, False, "low_revenue_rank")


def best_customers(star: Star) -> DataFrame:
    roles = star.roles
    by = ["customer_id", "full_name", "country", roles.age_group, roles.gender]
    lifetime = Metric("lifetime_revenue", "sum", "sales_amount")
    groups = with_average(sales_by(star, "dim_customer", by, lifetime, PRICED), lifetime.name)
    board = leaderboard(groups, lifetime.name, 10, "clv_rank", by)
    return board.select(*by, ORDERS, lifetime.name, AVERAGE, "clv_rank")


def products_in_category(star: Star, method: str = "dense_rank") -> DataFrame:
    groups = sales_by(star, "dim_product", PRODUCT, REVENUE, UNITS, orders=False)
    groups, rows = settled(groups, star.rows("dim_product"))
    ways = {"method": method, "ties": PRODUCT}
    ranked = with_rank(groups, REVENUE.name, "global_rank", rows, **ways)
    ranked = with_rank(ranked, REVENUE.name, "rank_within_category", rows, ["category"], **ways)
    ordered = ranked.orderBy("category", "rank_within_category", *PRODUCT)
    return ordered.select(
        "category",
        "subcategory",
        "product_name",
        REVENUE.name,
        UNITS.name,
        "global_rank",
        "rank_within_category",
    )


def product_types_alike(star: Star, collation: str) -> DataFrame:
    """Ten subcategories by revenue, spellings that compare equal taken together."""
    by = ["category", "subcategory"]
    groups = sales_by(star, "dim_product", by, UNITS, REVENUE, orders=False)
    merged = one_spelling(groups, by, [UNITS, REVENUE], collation)
    return leaderboard(merged, REVENUE.name, 10, "revenue_rank", by)


def best_in_category(star: Star, method: str, k: int = 3) -> DataFrame:
    """The best products of each category: three of them, or all of the first three ranks."""
    groups = sales_by(star, "dim_product", PRODUCT, UNITS, REVENUE, orders=False)
    groups, rows = settled(groups, star.rows("dim_product"))
    best = best_per_group(
        groups, REVENUE.name, k, "rank_within_category", ["category"], rows, PRODUCT, method=method
    )
    return best.orderBy("category", "rank_within_category", *PRODUCT)


def sales_by_place(star: Star) -> DataFrame:
    """Every sale with its percent rank by amount, among all sales and among those of its year."""
    sales = star.fact_sales.select("order_number", "order_year", "sales_amount")
    ranked = with_percent_rank(sales, "sales_amount", "percent_rank")
    return with_percent_rank(ranked, "sales_amount", "percent_rank_in_year", ["order_year"])


def stores_two_ways(star: Star) -> DataFrame:
    """Revenue rank beside the rank of the on-time rate.

    Both parts of the rate are exact counts and it is divided once, so equal rates tie.
    """
    punctual = Metric("on_time", "sum", "case when delivery_status = 'On Time' then 1 else 0 end")
    groups = sales_by(star, "dim_store", STORE, REVENUE, punctual, Metric("lines", "count", "*"))
    rated = groups.withColumn("on_time_pct", half_up("on_time * 100", "lines", 2)).withColumn(
        "rate", F.expr("double(on_time) / nullif(double(lines), 0)")
    )
    rated, rows = settled(rated, star.rows("dim_store"))
    ranked = with_rank(rated, REVENUE.name, "revenue_rank", rows)
    ranked = with_rank(ranked, "rate", "delivery_rank", rows)
    return ranked.drop("on_time", "lines", "rate").orderBy("revenue_rank", *STORE)


def months(star: Star) -> DataFrame:
    revenue = Metric("monthly_revenue", "sum", "sales_amount")
    groups = sales_by_own(star, MONTH, revenue)
    ranked = with_rank(groups, revenue.name, "overall_rank", MAX_MONTHS)
    ranked = with_rank(ranked, revenue.name, "rank_within_year", MAX_MONTHS, ["order_year"])
    return ranked.orderBy(*MONTH)


def countries_by_returns(star: Star) -> DataFrame:
    """Returns per hundred orders, worst country first."""
    by = ["country", "continent"]
    unique = star.unique("fact_sales", "fact_returns", "dim_customer")
    groups = _unique_returns(star, by) if unique else _distinct_returns(star, by)
    rated = groups.withColumn(
        "return_rate_pct", half_up("total_returns * 100", ORDERS, 2)
    ).withColumn("rate", F.expr(f"double(total_returns) / nullif(double({ORDERS}), 0)"))
    rated, rows = settled(rated, star.rows("dim_customer"))
    ranked = with_rank(rated, "rate", "return_rank", rows).drop("rate")
    return ranked.orderBy("return_rank", *by)


def _unique_returns(star: Star, by: list[str]) -> DataFrame:
    """Orders and returns per group; returns are counted per order before the facts meet."""
    each = distinct_keys(star, "fact_returns", "returned")
    returns = by_attributes(star.fact_returns, ["order_number"], [each])
    sales = star.fact_sales.select("order_number", "customer_id")
    fact = sales.join(returns, "order_number", "left")
    orders = distinct_keys(star, "fact_sales", ORDERS, "dim_customer")
    returned = Metric("total_returns", "sum", "coalesce(returned, 0)")
    return by_dimension(fact, star.dim_customer, "customer_id", by, [orders, returned])


def _distinct_returns(star: Star, by: list[str]) -> DataFrame:
    """The same with keys that repeat, counting distinct orders and returns.

    Orders are reduced to the groups they were placed from before they meet returns, so
    an order number repeated in both facts meets each return once per group at most.
    """
    key = "customer_id"
    homes = star.dim_customer.select(key, *by).distinct()
    buyers = star.fact_sales.select("order_number", key).distinct()
    placed = buyers.join(homes, key).select(*by, "order_number").distinct()
    returns = star.fact_returns.select("order_number", "return_id").distinct()
    returned = placed.join(returns, "order_number").select(*by, "return_id").distinct()
    orders = placed.groupBy(*by).agg(F.count("order_number").alias(ORDERS))
    counted = returned.groupBy(*by).agg(F.count("return_id").alias("total_returns"))
    both = orders.withColumn("total_returns", F.lit(0).cast("bigint")).unionByName(
        counted.withColumn(ORDERS, F.lit(0).cast("bigint"))
    )
    sums = [F.sum(name).alias(name) for name in (ORDERS, "total_returns")]
    return both.groupBy(*by).agg(*sums)

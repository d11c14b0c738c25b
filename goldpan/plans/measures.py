"""Phase 4: how each measure is distributed."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldpan.functions import mean, percent
from goldpan.operators.measures import average, deviation, order_statistics, variation_pct
from goldpan.operators.quantiles import order_statistics_by
from goldpan.plans.star import KEYS, Star

QUARTILES = {"p25": Fraction(1, 4), "p50_median": Fraction(1, 2), "p75": Fraction(3, 4)}


def _moments(star: Star) -> list[Column]:
    amount = "sales_amount"
    kind = star.fact_sales.schema[amount].dataType
    return [
        F.count("*").alias("total_orders"),
        F.sum(amount).alias("total_revenue"),
        F.min(amount).alias("min_order_value"),
        F.max(amount).alias("max_order_value"),
        average(amount).alias("avg_order_value"),
        deviation(amount, kind=kind).alias("stddev_order_value"),
        variation_pct(amount, kind=kind).alias("cv_pct"),
    ]


def sales_profile(star: Star) -> DataFrame:
    return order_statistics(star.fact_sales, "sales_amount", QUARTILES, _moments(star))


def sales_profile_by(star: Star, dim: str, column: str) -> DataFrame:
    """The profile of sales per value of a dimension's column."""
    key = KEYS[dim]
    members = star.gold[dim].select(key, column)
    sold = star.fact_sales.select(key, "sales_amount").join(members, key)
    profile = order_statistics_by(sold, [column], "sales_amount", QUARTILES, _moments(star))
    return profile.orderBy(column)


def price_and_quantity(star: Star) -> DataFrame:
    fact = star.fact_sales
    per_unit = mean("sum(sales_amount)", "sum(quantity)")
    return fact.agg(
        F.min("price").alias("min_unit_price"),
        F.max("price").alias("max_unit_price"),
        average("price").alias("avg_unit_price"),
        deviation("price", kind=fact.schema["price"].dataType).alias("stddev_price"),
        F.min("quantity").alias("min_qty_per_order"),
        F.max("quantity").alias("max_qty_per_order"),
        average("quantity").alias("avg_qty_per_order"),
        F.sum("quantity").alias("total_units_sold"),
        per_unit.alias("effective_price_per_unit"),
    )


def returns_profile(star: Star) -> DataFrame:
    amount = "return_amount"
    kind = star.fact_returns.schema[amount].dataType
    return star.fact_returns.agg(
        F.count("*").alias("total_return_transactions"),
        F.sum(amount).alias("total_returned_value"),
        F.min(amount).alias("min_return_amount"),
        F.max(amount).alias("max_return_amount"),
        average(amount).alias("avg_return_amount"),
        deviation(amount, kind=kind).alias("stddev_return_amount"),
    )


def return_rate(star: Star) -> DataFrame:
    """Returned value as a percentage of sales value."""
    sold = star.fact_sales.agg(F.sum("sales_amount")).scalar()
    returned = star.fact_returns.agg(F.sum("return_amount").alias("returned"))
    both = returned.withColumn("sold", sold)
    return both.select(percent("returned", "sold").alias("return_rate_pct"))


def cost_by_category(star: Star) -> DataFrame:
    kind = star.dim_product.schema["cost"].dataType
    return (
        star.dim_product.groupBy("category")
        .agg(
            F.count("product_id").alias("product_count"),
            F.min("cost").alias("min_cost"),
            F.max("cost").alias("max_cost"),
            average("cost").alias("avg_cost"),
            deviation("cost", kind=kind).alias("stddev_cost"),
            (F.max("cost") - F.min("cost")).alias("cost_range"),
        )
        .orderBy(F.desc("avg_cost"), "category")
    )


def lead_time(star: Star) -> DataFrame:
    """Days to ship and days to due over orders where both are known."""
    known = star.fact_sales.where("days_to_ship IS NOT NULL AND days_to_due IS NOT NULL")
    statistics = []
    for column in ("days_to_ship", "days_to_due"):
        statistics += [
            F.min(column).alias(f"min_{column}"),
            F.max(column).alias(f"max_{column}"),
            average(column, 1).alias(f"avg_{column}"),
            deviation(column, 1, known.schema[column].dataType).alias(f"stddev_{column}"),
        ]
    return known.agg(*statistics)

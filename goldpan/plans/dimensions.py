"""Phase 2: the shape of every dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldpan.operators.audit import DISTINCT_COUNT, column_audit
from goldpan.operators.domain import domain, value_counts, with_share
from goldpan.operators.measures import average
from goldpan.plans.star import Star


def cardinality(star: Star, measure: str = DISTINCT_COUNT) -> DataFrame:
    label, value = "dimension_column", "distinct_values"
    counts = column_audit(
        star.dim_customer, star.roles.customer_categories, measure, label, value
    )
    return counts.orderBy(F.desc(value), label)


def customer_domain(star: Star, column: str) -> DataFrame:
    return domain(star.dim_customer, column, f"{column}_value")


def hierarchy(star: Star) -> DataFrame:
    return (
        star.dim_product.groupBy("category", "subcategory")
        .agg(
            F.count("product_id").alias("product_count"),
            F.min("cost").alias("min_cost"),
            F.max("cost").alias("max_cost"),
            average("cost").alias("avg_cost"),
        )
        .orderBy("category", "subcategory")
    )


def product_lines(star: Star) -> DataFrame:
    return domain(star.dim_product, "product_line", "product_line_value")


def maintenance(star: Star) -> DataFrame:
    return domain(star.dim_product, "maintenance_required", "maintenance_value")


def maintenance_by_category(star: Star) -> DataFrame:
    pair = ["category", "maintenance_required"]
    return value_counts(star.dim_product, pair, "product_count").orderBy(*pair)


def store_types(star: Star) -> DataFrame:
    return domain(star.dim_store, "store_type", "store_type_value")


def store_regions(star: Star) -> DataFrame:
    return domain(star.dim_store, "region", "region_value")


def store_matrix(star: Star) -> DataFrame:
    pair = ["store_type", "region"]
    return value_counts(star.dim_store, pair, "store_count", counted="store_id").orderBy(*pair)


def _shares(star: Star, name: str, column: str, counted: str) -> DataFrame:
    groups = value_counts(star.gold[name], [column], counted)
    shared = with_share(groups, counted, "pct_of_total", star.rows(name))
    return shared.orderBy(F.desc(counted), column)


def status_share(star: Star) -> DataFrame:
    return _shares(star, "fact_sales", "delivery_status", "order_count")


def reason_share(star: Star) -> DataFrame:
    return _shares(star, "fact_returns", "return_reason", "return_count")

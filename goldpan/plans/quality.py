"""Phase 3: whether the data can be trusted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldpan.operators.audit import NULL_COUNT, column_audit
from goldpan.operators.measures import average
from goldpan.operators.profiles import profile
from goldpan.operators.quality import (
    coverage,
    duplicate_keys,
    expectations,
    flag_count,
    gate,
    not_among,
    not_between,
    orphans,
    orphans_alike,
    quoted,
    references,
    violations,
)
from goldpan.plans.star import KEYS, Star


def sales_dates(star: Star) -> DataFrame:
    return coverage(star.fact_sales, "order_date", "earliest_order", "latest_order")


def returns_dates(star: Star) -> DataFrame:
    spans = coverage(star.fact_returns, "return_date", "earliest_return", "latest_return")
    return spans.select("earliest_return", "latest_return", "span_months")


def _nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    counts = column_audit(df, columns, NULL_COUNT, "column_name", "null_count")
    return counts.orderBy(F.desc("null_count"), "column_name")


def customer_nulls(star: Star) -> DataFrame:
    return _nulls(star.dim_customer, star.roles.customer_audit)


def product_nulls(star: Star) -> DataFrame:
    return _nulls(star.dim_product, star.roles.product_audit)


def sales_nulls(star: Star) -> DataFrame:
    return _nulls(star.fact_sales, star.roles.sales_audit)


def returns_nulls(star: Star) -> DataFrame:
    return _nulls(star.fact_returns, star.roles.returns_audit)


def line_profile(star: Star) -> DataFrame:
    """What the raw order lines hold, merged from what is known of each of their files."""
    lines = star.source("lineitem")
    found = profile(lines, ",".join(sorted(lines.inputFiles())[:1]))
    exact = found.drop("distinct_estimate", "median_estimate")
    return exact.orderBy(F.desc("null_count"), "column_name")


def _lost(star: Star, fact: str, dim: str, key: str, name: str) -> DataFrame:
    unique = KEYS[dim] == key and star.unique(dim)
    return orphans(star.gold[fact], key, star.gold[dim], key, name, unique)


def orphan_customers(star: Star) -> DataFrame:
    return _lost(star, "fact_sales", "dim_customer", "customer_id", "orphan_customers")


def orphan_products(star: Star) -> DataFrame:
    return _lost(star, "fact_sales", "dim_product", "product_id", "orphan_products")


def orphan_stores(star: Star) -> DataFrame:
    return _lost(star, "fact_sales", "dim_store", "store_id", "orphan_stores")


def orphan_returns(star: Star) -> DataFrame:
    return _lost(star, "fact_returns", "fact_sales", "order_number", "orphan_returns")


def orphan_references(star: Star) -> DataFrame:
    """Orphans of every dimension that sales refer to, from one scan of them."""
    checks = {
        name: (KEYS[dim], star.gold[dim], KEYS[dim])
        for name, dim in (
            ("orphan_customers", "dim_customer"),
            ("orphan_products", "dim_product"),
            ("orphan_stores", "dim_store"),
        )
    }
    return references(star.fact_sales, checks)


def customers_beyond_stores(star: Star, collation: str) -> DataFrame:
    """Customers of continents that no store's region is spelt like."""
    return orphans_alike(
        star.dim_customer, "continent", star.dim_store, "region", "customers_beyond_stores", collation
    )


def duplicates(star: Star, name: str) -> DataFrame:
    return duplicate_keys(star.gold[name], [KEYS[name]])


def sanity(star: Star) -> DataFrame:
    """Extremes, average and out-of-range counts of one customer attribute."""
    roles = star.roles
    column = roles.sanity_column
    return star.dim_customer.agg(
        F.min(column).alias(roles.sanity_lowest),
        F.max(column).alias(roles.sanity_highest),
        average(column, 1).alias(f"avg_{column}"),
        flag_count(f"{column} < {roles.sanity_low}").alias(f"{column}_under_{roles.sanity_low}"),
        flag_count(f"{column} > {roles.sanity_high}").alias(f"{column}_over_{roles.sanity_high}"),
        flag_count(f"{column} is null").alias(f"{column}_null"),
    )


def sign_off(star: Star) -> DataFrame:
    """The gate: every expectation, reference and key with its violations and verdict.

    A missing value or key is a violation. Each object is scanned once for its rules, sales once
    for all their references and once for returns, and objects once more for the counts and
    variations that the roles expect of them, if any.
    """
    roles, parts = star.roles, []
    for name, df in star.gold.items():
        rules = {}
        for column, allowed in roles.domains.get(name, {}).items():
            rules[f"{name}.{column} domain"] = not_among(column, allowed)
        for column, (low, high) in roles.ranges.get(name, {}).items():
            rules[f"{name}.{column} range"] = not_between(column, low, high)
        key = KEYS[name]
        parts.append(violations(df, rules, key, f"{name}.{key}", star.unique(name)))
        expected = {}
        if name in roles.row_counts:
            expected[f"{name} row count"] = (F.count(F.lit(1)), *roles.row_counts[name])
        for column, bounds in roles.value_counts.get(name, {}).items():
            values = F.countDistinct(quoted(column))
            expected[f"{name}.{column} value count"] = (values, *bounds)
        for column, bounds in roles.variations.get(name, {}).items():
            value = quoted(column)
            spread = F.try_divide(F.stddev_samp(value) * 100, F.avg(value).cast("double"))
            expected[f"{name}.{column} variation"] = (spread, *bounds)
        if expected:
            parts.append(expectations(df, expected))
    for statement in (orphan_references, orphan_returns):
        lost = statement(star)
        pairs = [
            F.struct(
                F.lit(name.replace("_", " ")).alias("check_name"), F.col(name).alias("violations")
            )
            for name in lost.columns
        ]
        parts.append(lost.select(F.inline(F.array(*pairs))))
    return gate(parts)

"""Every statement by key."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldpan.functions import result_types
from goldpan.operators.audit import APPROXIMATE_DISTINCT_COUNT
from goldpan.operators.domain import domain
from goldpan.operators.quality import duplicate_keys, orphans
from goldpan.plans import dimensions, magnitudes, measures, quality, ranking, structure
from goldpan.plans.star import Star

Statement = Callable[[Star], DataFrame]


def _by_role(statement: Callable[..., DataFrame], role: str, **options) -> Statement:
    return lambda star: statement(star, getattr(star.roles, role), **options)


def _column(statement: Callable[..., DataFrame], column: str) -> Statement:
    return partial(statement, column=column)


STATEMENTS: dict[str, Statement] = {
    "p1_1_layer_inventory": structure.layer_inventory,
    "p1_2_object_inventory": structure.object_inventory,
    "p1_3_column_dictionary": structure.dictionary,
    "p1_4_row_counts": structure.gold_row_counts,
    "p2_1_cardinality": dimensions.cardinality,
    "p2_2a_domain_gender": _by_role(dimensions.customer_domain, "gender"),
    "p2_2b_domain_marital": _by_role(dimensions.customer_domain, "marital_status"),
    "p2_2c_domain_age_group": _by_role(dimensions.customer_domain, "age_group"),
    "p2_2d_domain_continent": _column(dimensions.customer_domain, "continent"),
    "p2_2e_domain_country": _column(dimensions.customer_domain, "country"),
    "p2_3_hierarchy": dimensions.hierarchy,
    "p2_4a_domain_product_line": dimensions.product_lines,
    "p2_4b_domain_maintenance": dimensions.maintenance,
    "p2_4c_crosstab": dimensions.maintenance_by_category,
    "p2_5a_domain_store_type": dimensions.store_types,
    "p2_5b_domain_region": dimensions.store_regions,
    "p2_5c_store_matrix": dimensions.store_matrix,
    "p2_6_status_share": dimensions.status_share,
    "p2_7_reason_share": dimensions.reason_share,
    "p3_1a_sales_date_coverage": quality.sales_dates,
    "p3_1b_returns_date_coverage": quality.returns_dates,
    "p3_2_nulls_customer": quality.customer_nulls,
    "p3_3_nulls_product": quality.product_nulls,
    "p3_4_nulls_sales": quality.sales_nulls,
    "p3_5_nulls_returns": quality.returns_nulls,
    "p3_6a_orphan_customers": quality.orphan_customers,
    "p3_6b_orphan_products": quality.orphan_products,
    "p3_6c_orphan_stores": quality.orphan_stores,
    "p3_6d_orphan_returns": quality.orphan_returns,
    "p3_7a_dup_customers": partial(quality.duplicates, name="dim_customer"),
    "p3_7b_dup_products": partial(quality.duplicates, name="dim_product"),
    "p3_7c_dup_orders": partial(quality.duplicates, name="fact_sales"),
    "p3_7d_dup_returns": partial(quality.duplicates, name="fact_returns"),
    "p3_8_age_sanity": quality.sanity,
    "p3_9_sign_off": quality.sign_off,
    "p4_1_sales_profile": measures.sales_profile,
    "p4_2_price_qty_profile": measures.price_and_quantity,
    "p4_3a_return_profile": measures.returns_profile,
    "p4_3b_return_rate": measures.return_rate,
    "p4_4_cost_by_category": measures.cost_by_category,
    "p4_5_lead_time": measures.lead_time,
    "p5_1_by_year": magnitudes.by_year,
    "p5_2_by_category": magnitudes.by_category,
    "p5_3_by_store_type": magnitudes.by_store_type,
    "p5_4a_by_continent": magnitudes.by_continent,
    "p5_4b_by_country": magnitudes.by_country,
    "p5_5_returns_by_category": magnitudes.returns_by_category,
    "p5_6a_by_age_group": _by_role(magnitudes.by_segment, "age_group"),
    "p5_6b_by_gender": _by_role(magnitudes.by_segment, "gender"),
    "p5_6c_by_marital": _by_role(magnitudes.by_segment, "marital_status", average=False),
    "p5_7_monthly_trend": magnitudes.monthly_trend,
    "p6_1_top10_products": ranking.best_products,
    "p6_2_bottom10_products": ranking.worst_products,
    "p6_3_top10_customers": ranking.best_customers,
    "p6_4_rank_in_category": ranking.products_in_category,
    "p6_5_store_dual_rank": ranking.stores_two_ways,
    "p6_6_month_rank": ranking.months,
    "p6_7_country_return_rate": ranking.countries_by_returns,
}


# Texts alike but for case, accents, forms of the apostrophe and blanks at their end.
ALIKE = "UNICODE_CI_AI_RTRIM"


def _lost(fact: str, key: str, dim: str, dim_key: str, name: str) -> Statement:
    return lambda star: orphans(star.source(fact), key, star.source(dim), dim_key, name)


def _repeated_texts(star: Star) -> DataFrame:
    """Equal documents by digest of the whole text, so no text is shuffled."""
    digest = F.sha2("text", 256).alias("text_sha256")
    return duplicate_keys(star.source("documents"), [digest])


# The same operators on the lake's own tables, where the checks find something, and the
# options no statement above uses.
VARIANTS: dict[str, Statement] = {
    "p2_1b_cardinality_approximate": partial(
        dimensions.cardinality, measure=APPROXIMATE_DISTINCT_COUNT
    ),
    "p2_2f_domain_segment_collated": lambda star: domain(
        star.dim_customer, "segment", "segment_value", "UTF8_LCASE_RTRIM"
    ),
    "p3_4b_line_profile": quality.line_profile,
    "p3_6e_orders_without_lines": _lost(
        "orders", "o_orderkey", "lineitem", "l_orderkey", "orders_without_lines"
    ),
    "p3_6f_documents_without_labels": _lost(
        "documents", "doc_id", "labels", "doc_id", "documents_without_labels"
    ),
    "p3_6g_customers_without_events": _lost(
        "customer", "c_custkey", "events", "user_id", "customers_without_events"
    ),
    "p3_6h_orphan_references": quality.orphan_references,
    "p3_6i_customers_beyond_stores": partial(
        quality.customers_beyond_stores, collation=ALIKE
    ),
    "p3_7e_dup_raw_lines": lambda star: duplicate_keys(
        star.source("lineitem"), ["l_orderkey", "l_linenumber"]
    ),
    "p3_7f_dup_document_texts": _repeated_texts,
    "p4_1b_profile_by_category": partial(
        measures.sales_profile_by, dim="dim_product", column="category"
    ),
    "p4_1c_profile_by_store_type": partial(
        measures.sales_profile_by, dim="dim_store", column="store_type"
    ),
    "p4_1d_sales_by_percent_rank": ranking.sales_by_place,
    "p5_6d_by_age_group_1995": _by_role(magnitudes.by_segment, "age_group", year=1995),
    "p5_6e_by_gender_1995": _by_role(magnitudes.by_segment, "gender", year=1995),
    "p5_6f_by_marital_1995": _by_role(
        magnitudes.by_segment, "marital_status", average=False, year=1995
    ),
    "p5_8_customer_groupings": magnitudes.customer_groupings,
    "p6_1b_top10_products_by_key": lambda star: ranking.product_board(
        star, True, "revenue_rank", by_key=True
    ),
    "p6_1c_top10_products_rank": lambda star: ranking.product_board(
        star, True, "revenue_rank", method="rank"
    ),
    "p6_1d_top10_products_row_number": lambda star: ranking.product_board(
        star, True, "revenue_rank", method="row_number"
    ),
    "p6_1e_top10_subcategories_alike": partial(
        ranking.product_types_alike, collation=ALIKE
    ),
    "p6_4b_rank_in_category_rank": partial(ranking.products_in_category, method="rank"),
    "p6_4c_rank_in_category_row_number": partial(
        ranking.products_in_category, method="row_number"
    ),
    "p6_4d_best3_in_category": partial(ranking.best_in_category, method="row_number"),
    "p6_4e_best3_ranks_in_category": partial(ranking.best_in_category, method="dense_rank"),
    "p6_4f_best3_places_in_category": partial(ranking.best_in_category, method="rank"),
}


def run(key: str, star: Star) -> DataFrame:
    """One statement's result, typed for output."""
    statement = STATEMENTS.get(key) or VARIANTS[key]
    return result_types(statement(star))

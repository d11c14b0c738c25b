"""Every statement on a small retail star, clean and broken, against SQL."""

from __future__ import annotations

import duckdb
import pytest

from goldpan.operators import ranking
from goldpan.plans.catalog import STATEMENTS, run
from goldpan.plans.star import KEYS, Roles, Star
from goldpan.sources import catalog_star, materialized
from goldpan.oracle.statements import statements
from tests.compare import assert_same
from tests.retail import database, frames

SQL = statements(Roles(), KEYS, "BIGINT")
KINDS = ["clean", "dirty", "dirty_facts", "dirty_dims", "one", "empty"]


@pytest.fixture(scope="module")
def stars(spark):
    built = {}
    for kind in KINDS:
        dfs = frames(spark, kind)
        con = duckdb.connect()
        database(con, dfs)
        built[kind] = Star(**dfs), con
    return built


def test_covers_every_statement_but_structure():
    assert {k for k in STATEMENTS if not k.startswith("p1")} == set(SQL)


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("key", SQL)
def test_matches_sql(stars, kind, key):
    star, con = stars[kind]
    assert_same(run(key, star), con, SQL[key])


def test_keys_are_proven_or_not(stars):
    clean, dirty = stars["clean"][0], stars["dirty"][0]
    assert clean.unique(*KEYS)
    assert not any(dirty.unique(name) for name in KEYS)
    assert stars["dirty_facts"][0].unique("dim_customer", "dim_product", "dim_store")
    assert stars["dirty_dims"][0].unique("fact_sales", "fact_returns")
    assert clean.proof("fact_sales").complete and not dirty.proof("fact_sales").complete


SPLIT = [
    "p2_6_status_share",
    "p4_1_sales_profile",
    "p5_2_by_category",
    "p5_3_by_store_type",
    "p5_4a_by_continent",
    "p5_5_returns_by_category",
    "p6_4_rank_in_category",
    "p6_5_store_dual_rank",
    "p6_6_month_rank",
    "p6_7_country_return_rate",
]


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("key", SPLIT)
def test_split_over_tasks_matches_sql(stars, monkeypatch, kind, key):
    """The same results when no order or total may pass through one task."""
    monkeypatch.setattr(ranking, "SINGLE_TASK_ROWS", -1)
    monkeypatch.setattr("goldpan.operators.domain.SINGLE_TASK_ROWS", -1)
    star, con = stars[kind]
    assert_same(run(key, star), con, SQL[key])


def test_views_answer_sql(spark, stars):
    star = stars["clean"][0]
    star.register()
    assert spark.sql("SELECT count(*) AS n FROM fact_sales").first()["n"] == star.rows("fact_sales")


def test_star_from_catalog_schemas(spark, tmp_path):
    dfs = frames(spark, "clean")
    for schema in ("bronze", "gold"):
        spark.sql(f"CREATE DATABASE {schema} LOCATION '{tmp_path}/{schema}'")
    dfs["dim_store"].write.option("path", f"{tmp_path}/bronze/raw").saveAsTable("bronze.raw_store")
    spark.sql("CREATE VIEW gold.dim_store AS SELECT * FROM bronze.raw_store")
    for name in set(KEYS) - {"dim_store"}:
        dfs[name].write.option("path", f"{tmp_path}/gold/{name}").saveAsTable(f"gold.{name}")
    star = catalog_star(spark, upstream=["bronze"])
    found = {(r.schema_name, r.object_name): r for r in run("p1_2_object_inventory", star).collect()}
    assert len(found) == 6
    assert found["gold", "dim_store"].object_type == "VIEW"
    assert found["gold", "dim_customer"].object_type == "BASE TABLE"
    assert found["bronze", "raw_store"].row_count == found["gold", "dim_store"].row_count == 12
    layers = {r.schema_name: r.object_count for r in run("p1_1_layer_inventory", star).collect()}
    assert layers == {"bronze": 1, "gold": 5}
    counts = [r.row_count for r in run("p1_4_row_counts", star).collect()]
    assert counts == sorted((df.count() for df in dfs.values()), reverse=True)
    described = run("p1_3_column_dictionary", star).where("object_name = 'dim_product'")
    nulls = {r.column_name: (r.data_type, r.null_count) for r in described.collect()}
    assert nulls["cost"] == ("decimal(18,2)", 2) and nulls["product_id"] == ("bigint", 0)
    assert run("p5_2_by_category", star).count() == 4


def test_materialized_star_answers_alike(stars):
    star, con = stars["dirty"]
    stored = materialized(star)
    assert stored.roles is star.roles and stored.rows("fact_sales") == star.rows("fact_sales")
    for key in ("p5_4b_by_country", "p6_7_country_return_rate"):
        assert_same(run(key, stored), con, SQL[key])

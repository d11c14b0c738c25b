"""Every registered query against its SQL on the smallest lake."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from goldpan.plans.catalog import STATEMENTS, VARIANTS
from tests.conftest import LAKE, settings
from tests.compare import assert_same

# Operators of other parts have tests of their own.
KEYS = [*STATEMENTS, *VARIANTS]
QUERIES = {key: contract.queries()[key] for key in KEYS}
SQL = {key: contract.oracle_sql()[key] for key in KEYS}


@pytest.mark.parametrize("key", QUERIES)
def test_matches_sql(spark, lake_db, key):
    assert_same(QUERIES[key](spark, LAKE), lake_db, SQL[key])


JOINS = [k for k in QUERIES if k.startswith(("p3_6", "p3_9", "p5_", "p6_"))]


@pytest.mark.parametrize("key", JOINS)
def test_shuffled_joins_match_sql(spark, lake_db, key):
    """The same results when no side of a join is small enough to broadcast."""
    never = {
        "spark__sql__autoBroadcastJoinThreshold": "-1",
        "spark__sql__adaptive__autoBroadcastJoinThreshold": "-1",
    }
    with settings(spark, **never):
        assert_same(QUERIES[key](spark, LAKE), lake_db, SQL[key])


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["category", "total_orders", "units_sold", "total_revenue", "revenue_pct"]
    assert df.count() > 0

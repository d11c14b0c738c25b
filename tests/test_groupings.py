"""Several groupings from one scan, on stars whose keys are proven and not."""

from __future__ import annotations

import re

import duckdb
import pytest

from goldpan.oracle.statements import variants
from goldpan.plans.catalog import run
from goldpan.plans.star import Roles, Star
from goldpan.sources import gold
from tests.compare import assert_same
from tests.conftest import LAKE
from tests.retail import database, frames
from tests.test_plans import plan, scans

KEY = "p5_8_customer_groupings"


@pytest.mark.parametrize("kind", ["clean", "dirty", "dirty_facts", "dirty_dims", "one", "empty"])
def test_matches_sql(spark, kind):
    dfs = frames(spark, kind)
    con = duckdb.connect()
    database(con, dfs)
    found = run(KEY, Star(**dfs))
    assert_same(found, con, variants(Roles())[KEY])
    if kind != "empty":
        assert {r["grouping"] for r in found.collect()} == {
            "continent", "country", "age group", "gender", "marital status",
        }


def test_the_fact_is_read_and_reduced_once(spark):
    text = plan(run(KEY, gold.lake_star(spark, LAKE)))
    assert scans(text) == 2
    # Members are copied for the sets, after facts have become a row per customer.
    assert re.search(r"HashAggregate\(keys=\[customer_id#\d+L\], functions=\[partial_", text)
    assert text.index("Expand") < text.index("HashAggregate(keys=[customer_id")

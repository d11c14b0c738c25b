"""Groups and references whose texts need only compare equal under a collation."""

from __future__ import annotations

import duckdb
import pytest

from goldpan.operators.domain import one_spelling
from goldpan.operators.magnitudes import Metric
from goldpan.operators.quality import orphans_alike
from goldpan.oracle.statements import variants
from goldpan.plans.catalog import ALIKE, run
from goldpan.plans.star import Roles, Star
from tests.compare import assert_same
from tests.conftest import settings
from tests.retail import database, frames
from tests.test_plans import NO_BROADCAST

KEYS = ["p3_6i_customers_beyond_stores", "p6_1e_top10_subcategories_alike"]


def test_one_spelling(spark):
    rows = [
        ("Men's", "Été", 1), ("men's", "ete", 2), ("MEN'S ", "ÉTÉ", 3), ("Mens", "été", 4),
        (None, "x", 5), (None, "X", 6), ("", "x", None),
    ]
    df = spark.createDataFrame(rows, "`the name` string, kind string, sold int")
    metrics = [Metric("sold", "sum", "sold"), Metric("lines", "count", "sold")]
    groups = df.groupBy("the name", "kind").agg(*(m.over_rows() for m in metrics))
    found = {tuple(r) for r in one_spelling(groups, ["the name", "kind"], metrics, ALIKE).collect()}
    assert found == {
        ("MEN'S ", "ete", 6, 3), ("Mens", "été", 4, 1), (None, "X", 11, 2), ("", "x", None, 0),
    }
    with pytest.raises(ValueError):
        one_spelling(groups, ["kind"], [Metric("n", "distinct", "sold")], ALIKE)


@pytest.mark.parametrize("broadcast", [True, False])
def test_orphans_alike(spark, broadcast):
    fact = spark.createDataFrame(
        [("Men's",), ("MEN'S",), ("men’s",), ("Zoé ",), ("zoe",), (None,), ("",)] * 3, "`the key` string"
    )
    dim = spark.createDataFrame([("men's",), ("MEN'S  ",), ("ZOÉ",), (None,)], "k string")
    with settings(spark, **({} if broadcast else NO_BROADCAST)):
        assert orphans_alike(fact, "the key", dim, "k", "n", ALIKE).first()["n"] == 6
        assert orphans_alike(fact, "the key", dim, "k", "n", "UTF8_BINARY").first()["n"] == 21
        assert orphans_alike(fact, "the key", dim.limit(0), "k", "n", ALIKE).first()["n"] == 21


@pytest.mark.parametrize("kind", ["clean", "dirty", "one", "empty"])
def test_matches_sql(spark, kind):
    dfs = frames(spark, kind)
    con = duckdb.connect()
    database(con, dfs)
    for key in KEYS:
        assert_same(run(key, Star(**dfs)), con, variants(Roles())[key])

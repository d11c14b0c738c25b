"""Boards per group, percent ranks and references in one scan, against brute force and SQL."""

from __future__ import annotations

import random
import re

import duckdb
import pytest

from goldpan.operators import quality, ranking
from goldpan.oracle.statements import variants
from goldpan.plans.catalog import run
from goldpan.plans.star import Roles, Star
from goldpan.sources import gold
from tests.compare import assert_same
from tests.conftest import LAKE, settings
from tests.retail import database, frames
from tests.test_plans import plan, scans

KEYS = [
    "p3_6h_orphan_references",
    "p4_1d_sales_by_percent_rank",
    "p6_4d_best3_in_category",
    "p6_4e_best3_ranks_in_category",
    "p6_4f_best3_places_in_category",
]
SQL = variants(Roles())


@pytest.fixture(scope="module")
def stars(spark):
    built = {}
    for kind in ("clean", "dirty", "dirty_facts", "dirty_dims", "one", "empty"):
        dfs = frames(spark, kind)
        con = duckdb.connect()
        database(con, dfs)
        built[kind] = Star(**dfs), con
    return built


@pytest.mark.parametrize("split", [False, True])
@pytest.mark.parametrize("kind", ["clean", "dirty", "dirty_facts", "dirty_dims", "one", "empty"])
def test_matches_sql(stars, monkeypatch, kind, split):
    if split:
        monkeypatch.setattr(ranking, "SINGLE_TASK_ROWS", -1)
    star, con = stars[kind]
    for key in KEYS if split else KEYS[:1] + KEYS[2:]:
        assert_same(run(key, star), con, SQL[key])


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("method", ["row_number", "rank", "dense_rank"])
@pytest.mark.parametrize("switch", [10**6, -1])
def test_best_per_group(spark, monkeypatch, switch, method, descending):
    monkeypatch.setattr(ranking, "SINGLE_TASK_ROWS", switch)
    rnd = random.Random(7)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([None, 1, 2, 3, 4, 5]), i) for i in range(200)]
    rows += [("hot", 9, 1000 + i) for i in range(300)] + [("hot", i, 2000 + i) for i in range(9)]
    df = spark.createDataFrame(rows, "g string, v int, id int").repartition(5)
    for k in (1, 3):
        found = ranking.best_per_group(
            df, "v", k, "r", ["g"], len(rows), ["id"], descending, method
        ).collect()
        got = {r["id"]: r["r"] for r in found}
        assert len(got) == len(found)
        want = {}
        for group in {r[0] for r in rows}:
            own = [r for r in rows if r[0] == group]
            low = (lambda r: (r[1] is None, -(r[1] or 0))) if descending else (lambda r: (r[1] is not None, r[1] or 0))
            own.sort(key=lambda r: (low(r), r[2]))
            for i, r in enumerate(own):
                above = [low(x) for x in own if low(x) < low(r)]
                place = {"row_number": i, "rank": len(above), "dense_rank": len(set(above))}[method]
                if place < k:
                    want[r[2]] = place + 1
        assert got == want
    with pytest.raises(ValueError, match="unknown method"):
        ranking.best_per_group(df, "v", 1, "r", ["g"], 1, ["id"], method="ntile")


def test_best_of_more_than_the_engine_limits(spark, monkeypatch):
    monkeypatch.setattr(ranking, "SINGLE_TASK_ROWS", 10)
    df = spark.range(3000).selectExpr("id % 2 as g", "id as v")
    with settings(spark, spark__sql__optimizer__windowGroupLimitThreshold="5"):
        found = ranking.best_per_group(df, "v", 7, "r", ["g"], 3000, ["v"], method="row_number")
        assert sorted(r["v"] for r in found.collect()) == list(range(2986, 3000))


@pytest.mark.parametrize("by", [[], ["g"], ["g", "h"]])
def test_percent_rank(spark, by):
    rnd = random.Random(len(by))
    rows = [
        (rnd.choice(["a", "b", None]), rnd.randint(0, 2), rnd.choice([None, 1.5, 2.5, *range(30)]), i)
        for i in range(300)
    ]
    rows = [(g, h, None if v is None else float(v), i) for g, h, v, i in rows]
    rows += [("hot", 0, 4.0, 1000 + i) for i in range(400)] + [("alone", 7, 1.0, 2000)]
    df = spark.createDataFrame(rows, "g string, h int, v double, id int").repartition(5)
    found = ranking.with_percent_rank(df, "v", "p", by)
    assert found.columns == ["g", "h", "v", "id", "p"]
    got = {r["id"]: r["p"] for r in found.collect()}
    low = lambda v: (v is not None, v or 0.0)
    groups = {}
    for r in rows:
        groups.setdefault(r[: len(by)], []).append(r)
    for own in groups.values():
        for r in own:
            before = sum(low(x[2]) < low(r[2]) for x in own)
            assert got[r[3]] == (before / (len(own) - 1) if len(own) > 1 else 0.0)
    assert len(got) == len(rows)
    assert ranking.with_percent_rank(df.limit(0), "v", "p", by).count() == 0


def test_references_of_several_types(spark):
    fact = spark.createDataFrame(
        [(1, "x", 1.0), (1, "x", 2.0), (2, None, 3.0), (None, "y", None)], "`a b` int, s string, d double"
    )
    numbers = spark.createDataFrame([(1,), (1,), (None,)], "`the id` long")
    texts = spark.createDataFrame([("x",), ("z",)], "s string")
    tenths = spark.createDataFrame([(2,)], "n int")
    checks = {"one": ("a b", numbers, "the id"), "two": ("s", texts, "s"), "three": ("d", tenths, "n")}
    assert tuple(quality.references(fact, checks).first()) == (2, 2, 3)
    assert tuple(quality.references(fact, {"one": checks["one"]}).first()) == (2,)
    assert tuple(quality.references(fact.limit(0), checks).first()) == (0, 0, 0)
    assert tuple(quality.references(fact, {"one": ("a b", numbers.limit(0), "the id")}).first()) == (4,)


@pytest.fixture(scope="module")
def lake(spark):
    return gold.lake_star(spark, LAKE)


def test_groups_are_limited_before_the_shuffle(lake):
    for key in ("p6_4d_best3_in_category", "p6_4e_best3_ranks_in_category"):
        text = plan(run(key, lake))
        final = text.index("WindowGroupLimit")
        shuffled = text.index("Exchange hashpartitioning(category", final)
        assert "Partial" in text[text.index("WindowGroupLimit", shuffled) :].split("\n")[0]


def test_references_read_the_fact_once(lake):
    text = plan(run("p3_6h_orphan_references", lake))
    read = re.findall(r"ReadSchema: struct<(.*?)>", text)
    assert sum("product_id" in r and "store_id" in r for r in read) == 1
    assert scans(text) == 4  # sales and three dimensions


def test_percent_ranks_order_nothing_in_one_task(lake):
    assert "SinglePartition" not in plan(run("p4_1d_sales_by_percent_rank", lake))

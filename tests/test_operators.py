"""Operators on hand-made frames, against brute force."""

from __future__ import annotations

import math
import random
from datetime import date
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from goldpan.operators import measures, quality, ranking
from goldpan.operators.audit import APPROXIMATE_DISTINCT_COUNT, column_audit
from goldpan.operators.domain import domain, value_counts, with_share
from goldpan.operators.measures import order_statistics
from goldpan.operators.ranking import leaderboard, order_positions, with_rank


@pytest.fixture(params=[10**6, -1], ids=["one_task", "many_tasks"])
def single_task_rows(request, monkeypatch):
    monkeypatch.setattr(ranking, "SINGLE_TASK_ROWS", request.param)


def sort_key(descending):
    """NULLs first ascending, last descending."""
    return lambda v: (v is not None, v if v is not None else 0) if not descending else (v is None, -(v or 0))


@pytest.mark.parametrize("descending", [False, True])
def test_order_positions(spark, single_task_rows, descending):
    rnd = random.Random(3)
    rows = [(rnd.choice("ab") if rnd.random() < 0.9 else None, rnd.choice([None, *range(40)])) for _ in range(400)]
    rows += [("a", 7)] * 200
    df = spark.createDataFrame(rows, "g string, x int")
    found = order_positions(df, "x", len(rows), ["g"], descending).collect()
    key = sort_key(descending)
    assert len(found) == len(set(rows))
    for r in found:
        earlier = [x for g, x in rows if g == r.g and key(x) < key(r.x)]
        assert (r.rows_before, r.values_before) == (len(earlier), len(set(earlier)))
        assert r.rows_at == rows.count((r.g, r.x))


@pytest.mark.parametrize("method", ["dense_rank", "rank"])
def test_with_rank(spark, single_task_rows, method):
    rnd = random.Random(4)
    rows = [(i, rnd.choice("ab"), rnd.choice([None, 1.5, 2.5, 3.5])) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, g string, x double")
    key = sort_key(True)
    for r in with_rank(df, "x", "place", len(rows), ["g"], method=method).collect():
        above = [x for _, g, x in rows if g == r.g and key(x) < key(r.x)]
        assert r.place == 1 + len(set(above) if method == "dense_rank" else above)


def test_leaderboard_with_a_tie_across_the_last_place(spark):
    revenue = [9, 8, 8, 7, 6, 5, 5, 5, 5, 5, 5, 4]
    df = spark.createDataFrame([(f"n{i:02}", v) for i, v in enumerate(revenue)], "name string, v int")
    expected = {
        "dense_rank": [1, 2, 2, 3, 4, 5, 5, 5, 5, 5],
        "rank": [1, 2, 2, 4, 5, 6, 6, 6, 6, 6],
        "row_number": list(range(1, 11)),
    }
    for method, ranks in expected.items():
        board = leaderboard(df, "v", 10, "r", ["name"], method=method).collect()
        assert [row.r for row in board] == ranks
        assert [row.name for row in board] == [f"n{i:02}" for i in range(10)]
    lowest = leaderboard(df, "v", 3, "r", ["name"], descending=False).collect()
    assert [(row.name, row.r) for row in lowest] == [("n11", 1), ("n05", 2), ("n06", 2)]


QUARTERS = {"a": Fraction(1, 4), "b": Fraction(1, 2), "c": Fraction(3, 4), "lo": Fraction(0), "hi": Fraction(1)}


def test_order_statistics(spark, single_task_rows):
    rnd = random.Random(5)
    for n in [0, 1, 2, 3, 4, 5, 9, 50]:
        for values in (
            [rnd.choice([None, *range(-5, 6)]) for _ in range(n)],
            [None] * n,
            [3] * n,
            [None] * (n // 2) + list(range(n - n // 2)),
        ):
            df = spark.createDataFrame([(None if v is None else Decimal(v) / 4,) for v in values], "x decimal(18,2)")
            ordered = sorted(values, key=sort_key(False))
            expected = [ordered[math.floor(f * (n - 1))] if n else None for f in QUARTERS.values()]
            found = order_statistics(df, "x", QUARTERS).collect()
            assert len(found) == 1
            assert list(found[0]) == [None if v is None else Decimal(v) / 4 for v in expected]


@pytest.mark.parametrize("bins", [2, 7, 4096])
@pytest.mark.parametrize("kind", ["decimal(18,2)", "double", "bigint", "date"])
def test_order_statistics_of_ties_nulls_and_one_heavy_value(spark, monkeypatch, bins, kind):
    """Refined down to single values: no row is left to one task."""
    monkeypatch.setattr(measures, "BINS", bins)
    monkeypatch.setattr(ranking, "SINGLE_TASK_ROWS", 3)
    rnd = random.Random(bins)
    for heavy, nulls in ((0, 0), (300, 0), (0, 200), (150, 37)):
        numbers = [rnd.choice([rnd.randint(-500, 500), rnd.randint(0, 10**6)]) for _ in range(200)]
        numbers += [77] * heavy + [None] * nulls
        make = {
            "decimal(18,2)": lambda n: Decimal(n) / 4,
            "double": lambda n: n / 8,
            "bigint": int,
            "date": lambda n: date.fromordinal(700_000 + n),
        }[kind]
        own = [None if n is None else make(n) for n in numbers]
        df = spark.createDataFrame([(v,) for v in own], f"`the value` {kind}")
        row = order_statistics(df, "the value", QUARTERS, [F.count("*").alias("rows")]).first()
        order = sorted(own, key=lambda v: (v is not None, v if v is not None else 0))
        assert row["rows"] == len(own)
        for name, fraction in QUARTERS.items():
            assert row[name] == order[math.floor(fraction * (len(own) - 1))]


def test_order_statistics_of_values_closer_than_doubles(spark, monkeypatch):
    monkeypatch.setattr(ranking, "SINGLE_TASK_ROWS", 3)
    big = 10**18
    df = spark.createDataFrame([(big + i,) for i in range(20)], "x bigint")
    assert order_statistics(df, "x", {"m": Fraction(1, 2)}).first()["m"] == big + 9


def test_shares_sum_to_a_hundred(spark, single_task_rows):
    df = spark.createDataFrame([(c,) for c in "aaabbc"] + [(None,)], "c string")
    shares = with_share(value_counts(df, ["c"], "n"), "n", "pct", 7)
    found = {r.c: r.pct for r in shares.collect()}
    assert found == {"a": Decimal("42.86"), "b": Decimal("28.57"), "c": Decimal("14.29"), None: Decimal("14.29")}


def test_share_of_nothing_is_null(spark):
    df = spark.createDataFrame([("a", 0)], "c string, n int")
    assert with_share(df, "n", "pct", 1).first().pct is None


def test_domain_collation(spark):
    df = spark.createDataFrame([(v,) for v in ["M", "m", "Male", "MALE", "M ", None]], "g string")
    assert domain(df, "g", "v").count() == 6
    assert domain(df, "g", "v", "UTF8_LCASE").count() == 4
    assert domain(df, "g", "v", "UTF8_LCASE_RTRIM").count() == 3
    assert [r.v for r in domain(df, "g", "v").collect()] == [None, "M", "M ", "MALE", "Male", "m"]


def test_approximate_cardinality(spark):
    df = spark.range(50_000).selectExpr("id as a", "id % 100 as b")
    found = {r.c: r.n for r in column_audit(df, ["a", "b"], APPROXIMATE_DISTINCT_COUNT, "c", "n").collect()}
    assert abs(found["a"] - 50_000) < 5_000 and abs(found["b"] - 100) < 10


@pytest.mark.parametrize("unique", [False, True])
def test_orphans_are_what_a_semi_join_leaves(spark, unique):
    fact = spark.createDataFrame([(1,)] * 50 + [(2,), (3,), (None,)], "k int")
    keys = [(1,), (2,)] if unique else [(1,)] * 30 + [(2,), (None,)]
    dim = spark.createDataFrame(keys, "id int")
    lost = quality.orphans(fact, "k", dim, "id", "n", unique).first().n
    matched = fact.join(dim, fact.k == dim.id, "left_semi").count()
    assert lost == fact.count() - matched == 2


def test_coverage_counts_month_boundaries(spark):
    df = spark.createDataFrame([(date(2023, 1, 31),), (date(2023, 2, 1),), (None,)], "d date")
    row = quality.coverage(df, "d", "first", "last").first()
    assert (row.first, row.last) == (date(2023, 1, 31), date(2023, 2, 1))
    assert (row.span_months, row.years_covered, row.distinct_year_months) == (1, 1, 2)


def test_one_value_has_no_deviation(spark):
    df = spark.createDataFrame([(Decimal(5),)], "x decimal(18,2)")
    row = df.agg(measures.deviation("x").alias("s"), measures.variation_pct("x").alias("cv")).first()
    assert (row.s, row.cv) == (None, None)


def test_variation_around_zero_is_null(spark):
    df = spark.createDataFrame([(Decimal(5),), (Decimal(-5),)], "x decimal(18,2)")
    assert df.agg(measures.variation_pct("x")).first()[0] is None


def test_gate_reports_failures_first(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "z")], "k int, v string")
    rules = {
        "v domain": quality.not_among("v", ("a", "b")),
        "k range": quality.not_between("k", 0, 5),
    }
    checks = quality.gate([quality.violations(df, rules, "k", "k")])
    found = [(r.check_name, r.violations, r.verdict) for r in checks.collect()]
    assert found == [
        ("k unique", 1, "fail"),
        ("v domain", 1, "fail"),
        ("k present", 0, "pass"),
        ("k range", 0, "pass"),
    ]


@pytest.mark.parametrize("unique", [False, True])
def test_missing_values_and_keys_are_violations(spark, unique):
    """A NULL in every place, a domain with a quote, and a column that needs quoting."""
    rows = [(None, None), (None, "Men's"), (3, "x")]
    df = spark.createDataFrame(rows, "`the key` int, `odd ``name` string")
    rules = {
        "domain": quality.not_among("odd `name", ["Men's"]),
        "range": quality.not_between("the key", 1, 5),
    }
    found = {r[0]: r[1] for r in quality.violations(df, rules, "the key", "k", unique).collect()}
    assert found == {"domain": 2, "range": 2, "k unique": 0, "k present": 2}
    none = {r[0]: r[1] for r in quality.violations(df.limit(0), rules, "the key", "k", unique).collect()}
    assert set(none.values()) == {0}


def test_expectations(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "v double")
    bounds = {
        "rows": (F.count(F.lit(1)), 2, 2),
        "values": (F.countDistinct("v"), 3, 4),
        "spread": (F.stddev_samp(F.lit(None)), 0, 1),
    }
    found = {r[0]: r[1] for r in quality.expectations(df, bounds).collect()}
    assert found == {"rows": 0, "values": 1, "spread": 1}


@pytest.mark.parametrize("switch", [10**6, 0])
def test_row_numbers_on_both_sides_of_the_switch(spark, monkeypatch, switch):
    monkeypatch.setattr(ranking, "SINGLE_TASK_ROWS", switch)
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), rnd.choice([None, 1, 2, 2, 2]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, v int, id int")
    key = lambda r: (r[1] is None, -(r[1] or 0), r[2])
    for by in ([], ["g"]):
        ranked = ranking.with_rank(df, "v", "n", 300, by, method="row_number", ties=["id"])
        got = {r.id: r.n for r in ranked.collect()}
        for group in {r[0] for r in rows} if by else {None}:
            own = sorted((r for r in rows if not by or r[0] == group), key=key)
            assert [got[r[2]] for r in own] == list(range(1, len(own) + 1))
    with pytest.raises(ValueError, match="unknown method"):
        ranking.with_rank(df, "v", "n", 300, method="ntile")


def test_duplicate_keys_keep_null_as_a_value(spark):
    df = spark.createDataFrame([(None,), (None,), (1,), (1,), (1,), (2,)], "k int")
    assert [tuple(r) for r in quality.duplicate_keys(df, ["k"]).collect()] == [(1, 3), (None, 2)]
    assert quality.duplicate_keys(df, [F.col("k").alias("x")]).columns == ["x", "occurrences"]

"""Distinct counts over repeated keys: plans, and results against brute force."""

from __future__ import annotations

import random
from dataclasses import replace

import pytest

from goldpan.operators.magnitudes import Metric, by_dimension
from goldpan.oracle.gold import GOLD
from goldpan.oracle.statements import statements
from goldpan.plans.catalog import run
from goldpan.plans.star import KEYS, Proof
from goldpan.sources import gold
from tests.compare import assert_same
from tests.conftest import LAKE, settings
from tests.test_plans import NO_BROADCAST, plan

DISTINCT = ["p5_2_by_category", "p5_4a_by_continent", "p5_4b_by_country", "p5_6a_by_age_group"]


@pytest.fixture(scope="module")
def unproven(spark):
    """The lake's star, of which nothing is known about its keys."""
    star = gold.lake_star(spark, LAKE)
    unknown = {name: Proof(False, False) for name in KEYS}
    return replace(star, _proofs=unknown, _rows={n: star.rows(n) for n in KEYS})


@pytest.mark.parametrize("key", DISTINCT)
def test_no_row_is_copied_and_no_fact_moved(unproven, key):
    text = plan(run(key, unproven))
    assert "Expand" not in text
    assert "hashpartitioning(value__" not in text and "hashpartitioning(order_number" not in text
    for line in text.splitlines():  # of the facts only keys move, to be told apart
        if "Exchange hashpartitioning" in line:
            assert "value__" not in line.split("hashpartitioning(")[1].split(")")[0]


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("key", DISTINCT)
def test_matches_sql_without_proofs(spark, unproven, lake_db, key, broadcast):
    sql = statements(gold.LAKE_ROLES, KEYS, "DOUBLE")[key]
    with settings(spark, **({} if broadcast else NO_BROADCAST)):
        assert_same(run(key, unproven), lake_db, f"WITH {GOLD.strip()}\nSELECT * FROM ({sql})")


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("counted", [True, False])
def test_by_dimension_with_two_distinct_counts(spark, how, counted):
    rnd = random.Random(how)
    pick = lambda *values: rnd.choice([None, *values])
    facts = [(pick(*range(8)), pick("x", "y", "z", "w"), pick(1, 2), rnd.randint(1, 9)) for _ in range(120)]
    members = [(pick(*range(12)), pick("a", "b"), rnd.choice(["it's", "k"])) for _ in range(25)]
    fact = spark.createDataFrame(facts, "id long, number string, kind int, `sold` int").repartition(3)
    dim = spark.createDataFrame(members, "id long, copies string, `the name` string")
    metrics = [
        Metric("orders", "distinct", "number"), Metric("units", "sum", "sold"),
        Metric("lines", "count", "sold"), Metric("kinds", "distinct", "kind * 2"),
    ]
    own = Metric("n", "count", "id") if counted else None
    found = by_dimension(fact, dim, "id", ["copies", "the name"], metrics, how, own)
    assert "Expand" not in plan(found)
    got = {tuple(r)[:2]: tuple(r)[2:] for r in found.collect()}
    want = {}
    for group in {m[1:] for m in members}:
        ids = [m[0] for m in members if m[1:] == group]
        pairs = [f for f in facts for i in ids if f[0] is not None and f[0] == i]
        if not pairs and how == "inner":
            continue
        seen = {i for i in ids if i is not None and (how == "left" or any(f[0] == i for f in facts))}
        row = (
            len({f[1] for f in pairs} - {None}), sum(f[3] for f in pairs) if pairs else None,
            len(pairs), len({f[2] for f in pairs} - {None}),
        )
        want[group] = ((len(seen),) if counted else ()) + row
    assert got == want

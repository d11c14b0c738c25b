"""Column profiles merged from the states of files."""

from __future__ import annotations

import random

import pytest

from goldpan.operators import profiles


def rows(n, seed):
    rnd = random.Random(seed)
    return [
        (i if rnd.random() < 0.9 else None, rnd.choice(["a", "bb", "é" * 5, None]), rnd.gauss(0, 10), None, [i])
        for i in range(n)
    ]


SHAPE = "`the id` long, `it's` string, x double, none int, list array<long>"


def exact(found):
    names = [c for c in found.columns if not c.endswith("_estimate")]
    return sorted(map(tuple, found.select(*names).collect()))


@pytest.fixture
def table(spark, tmp_path):
    folder = f"{tmp_path}/table"

    def add(n, seed, parts=1):
        spark.createDataFrame(rows(n, seed), SHAPE).repartition(parts).write.mode("append").parquet(folder)
        return spark.read.schema(SHAPE).parquet(folder)

    return add


def test_new_files_alone_are_read(spark, table, tmp_path, monkeypatch):
    store, whole = f"{tmp_path}/store", f"{tmp_path}/whole"
    source = table(500, 1, parts=3)
    assert len(profiles.refresh(source, store)) == 3
    assert profiles.refresh(source, store) == []
    source = table(40, 2)
    read = []
    own = profiles._profiled
    monkeypatch.setattr(profiles, "_profiled", lambda df: read.append(df.inputFiles()) or own(df))
    (new,) = profiles.refresh(source, store)
    assert len(read) == 1 and len(read[0]) == 1 and read[0][0].split("/")[-1] == new.split("/")[-1]
    monkeypatch.undo()
    profiles.refresh(source, whole)
    got = profiles.merged(source, store)
    assert exact(got) == exact(profiles.merged(source, whole))
    assert got.count() == 5


def test_profile_by_definition(spark, table, tmp_path):
    source = table(700, 3, parts=4)
    profiles.refresh(source, f"{tmp_path}/s")
    found = {r["column_name"]: r for r in profiles.merged(source, f"{tmp_path}/s").collect()}
    data = rows(700, 3)
    for i, name in enumerate(["the id", "it's", "x", "none", "list"]):
        values = [r[i] for r in data if r[i] is not None]
        r = found[name]
        assert (r["row_count"], r["null_count"]) == (700, 700 - len(values))
        if name in ("the id", "x"):
            assert (r["lowest"], r["highest"]) == (min(values), max(values))
            place = sum(v < r["median_estimate"] for v in values) / len(values)
            assert abs(place - 0.5) < 0.03
        else:
            assert (r["lowest"], r["highest"], r["median_estimate"]) == (None, None, None)
        if name == "it's":
            assert (r["first_text"], r["last_text"], r["longest"]) == ("a", "é" * 5, 5)
        different = len({str(v) for v in values})
        assert abs(r["distinct_estimate"] - different) <= 0.05 * different


def test_merged_sketches_keep_their_error(spark, tmp_path):
    """Twenty files that share half of their values."""
    folder, store = f"{tmp_path}/t", f"{tmp_path}/s"
    for i in range(20):
        df = spark.range(5000).selectExpr(f"id + {2500 * i} AS v")
        df.coalesce(1).write.mode("append").parquet(folder)
    source = spark.read.parquet(folder)
    assert len(profiles.refresh(source, store)) == 20
    (r,) = profiles.merged(source, store).collect()
    different = 2500 * 19 + 5000
    assert abs(r["distinct_estimate"] - different) <= 0.05 * different
    assert abs(r["median_estimate"] - different / 2) <= 0.03 * different
    assert (r["row_count"], r["lowest"], r["highest"]) == (100_000, 0, different - 1)


def test_files_that_are_gone_or_written_anew(spark, tmp_path):
    folder, store = f"{tmp_path}/t", f"{tmp_path}/s"
    spark.createDataFrame(rows(50, 1), SHAPE).write.parquet(folder)
    profiles.refresh(spark.read.parquet(folder), store)
    spark.createDataFrame(rows(30, 2), SHAPE).write.mode("overwrite").parquet(folder)
    source = spark.read.parquet(folder)
    assert profiles.refresh(source, store)
    assert {r["row_count"] for r in profiles.merged(source, store).collect()} == {30}


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SHAPE).write.parquet(f"{tmp_path}/t")
    source = spark.read.schema(SHAPE).parquet(f"{tmp_path}/t")
    profiles.refresh(source, f"{tmp_path}/s")
    assert {r["row_count"] for r in profiles.merged(source, f"{tmp_path}/s").collect()} <= {0}

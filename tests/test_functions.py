"""Exact rounding and calendar expressions against Python's own arithmetic."""

from __future__ import annotations

import random
from datetime import date
from decimal import Decimal
from fractions import Fraction
from math import floor

import pytest
from pyspark.sql import functions as F

from goldpan.functions import (
    age,
    age_group,
    full_name,
    half_up,
    mean,
    month_boundaries,
    percent,
    result_types,
)


def rounded(ratio: Fraction, digits: int) -> Decimal:
    size = floor(abs(ratio) * 10**digits + Fraction(1, 2))
    return Decimal(size if ratio >= 0 else -size).scaleb(-digits)


@pytest.mark.parametrize("digits", [1, 2])
@pytest.mark.parametrize("integer", ["bigint", "decimal(38,0)"])
def test_half_up(spark, digits, integer):
    rnd = random.Random(1)
    pairs = [(5, 1000), (-5, 1000), (1, 200), (-1, 200), (0, 3), (3, 0), (None, 3), (3, None)]
    pairs += [(rnd.randint(-(10**6), 10**6), rnd.randint(-50, 50)) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    for row in df.withColumn("r", half_up("a", "b", digits, integer)).collect():
        expected = None
        if row.a is not None and row.b:
            expected = rounded(Fraction(row.a, row.b), digits)
        assert row.r == expected


def test_half_a_cent_rounds_away_from_zero(spark):
    df = spark.createDataFrame([(Decimal("0.01"), 2), (Decimal("-0.01"), 2)], "t decimal(18,2), n int")
    assert [r[0] for r in df.select(mean("t", "n")).collect()] == [Decimal("0.01"), Decimal("-0.01")]


def test_percent(spark):
    df = spark.createDataFrame([(Decimal(1), Decimal(3)), (Decimal(1), Decimal(0))], "a decimal(38,2), b decimal(38,2)")
    assert [r[0] for r in df.select(percent("a", "b")).collect()] == [Decimal("33.33"), None]


@pytest.mark.parametrize("kind", ["decimal(19,4)", "decimal(18,6)", "decimal(18,2)", "bigint"])
def test_means_and_shares_of_any_scale(spark, kind):
    rnd = random.Random(len(kind))
    places = int(kind[-2]) if kind.startswith("decimal") else 0
    values = [Decimal(rnd.randint(-(10**7), 10**7)).scaleb(-places) for _ in range(50)]
    values += [Decimal(149).scaleb(-places)] * 2 + [Decimal(-149).scaleb(-places)]
    native = [int(v) if kind == "bigint" else v for v in values]
    df = spark.createDataFrame([(v, i % 7) for i, v in enumerate(native)], f"v {kind}, g int")
    groups = df.groupBy("g").agg(F.sum("v").alias("t"), F.count("v").alias("n"))
    for r in groups.select("g", mean("t", "n").alias("m"), percent("t", "n").alias("p")).collect():
        own = [Fraction(v) for i, v in enumerate(values) if i % 7 == r.g]
        assert r.m == rounded(sum(own) / len(own), 2)
        assert r.p == rounded(sum(own) * 100 / len(own), 2)


def test_the_mean_is_not_that_of_a_rounded_sum(spark):
    df = spark.createDataFrame([(Decimal("0.0149"),)] * 2, "v decimal(19,4)")
    assert df.agg(mean("sum(v)", "count(v)")).first()[0] == Decimal("0.01")


def test_people(spark):
    rows = [("Ann", "Lee", date(2000, 2, 29)), (None, "Lee", date(2004, 3, 1)), (None, None, None),
            ("A", None, date(1960, 1, 1)), ("B", "C", date(2030, 1, 1))]
    df = spark.createDataFrame(rows, "first string, last string, born date")
    years = age(F.col("born"), date(2023, 2, 28))
    found = df.select(
        full_name(F.col("first"), F.col("last")).alias("name"), years.alias("age"), age_group(years).alias("band")
    ).collect()
    assert [tuple(r) for r in found] == [
        ("Ann Lee", 22, "20-29"), ("Lee", 18, "Under 20"), (None, None, "Unknown"),
        ("A", 63, "60+"), ("B C", None, "Unknown"),
    ]
    assert df.select(age(F.col("born"), date(2023, 3, 1))).first()[0] == 23
    bands = spark.range(18, 62).select(age_group(F.col("id")).alias("b")).distinct().collect()
    assert {r.b for r in bands} == {"Under 20", "20-29", "30-39", "40-49", "50-59", "60+"}


def test_large_totals_stay_exact(spark):
    big = Decimal(10**17) + Decimal("0.01")
    df = spark.createDataFrame([(big, 3 * 10**12)], "t decimal(38,2), n bigint")
    assert df.select(mean("t", "n")).first()[0] == rounded(Fraction(big) / (3 * 10**12), 2)


def test_month_boundaries(spark):
    days = [date(2023, 1, 31), date(2023, 2, 1), date(2024, 2, 29), date(2022, 12, 31)]
    df = spark.createDataFrame([(a, b) for a in days for b in days], "a date, b date")
    for row in df.withColumn("n", month_boundaries("a", "b")).collect():
        assert row.n == (row.b.year - row.a.year) * 12 + row.b.month - row.a.month


def test_result_types(spark):
    df = spark.sql("SELECT 1S AS s, 1 AS i, 1.5BD AS d, 1F AS f, 'x' AS t, DATE'2024-01-01' AS day")
    assert dict(result_types(df).dtypes) == {
        "s": "bigint",
        "i": "bigint",
        "d": "double",
        "f": "double",
        "t": "string",
        "day": "date",
    }

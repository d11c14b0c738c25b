"""Order statistics per group, exact, without a group's values passing one task.

Values of a group are counted in equal parts of an interval, partial sums per task. The parts that
hold a position sought are intervals of the next pass, and so on until few rows are left in
each or one value. Only those rows are put in order. What is known of the groups (counts,
positions, intervals) is a small table that is written after each pass; the rows meet
it by group, where Spark broadcasts it or splits a group of many rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from goldpan.operators import measures
from goldpan.operators.quality import quoted
from goldpan.sources.storage import kept

# Rows of one interval of one group that are put in order by a task.
FINAL_ROWS = 10_000


def _number(value: Column, kind: T.DataType) -> Column:
    """Halves of values, so that the gap between the largest doubles is one too."""
    own = F.unix_date(value) if isinstance(kind, T.DateType) else value
    return own.cast("double") / 2


def _finite(value: Column, kind: T.DataType) -> Column:
    """The value, or NULL where it is NaN or infinite."""
    if not isinstance(kind, (T.DoubleType, T.FloatType)):
        return value
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def order_statistics_by(
    df: DataFrame,
    by: Sequence[str],
    column: str,
    fractions: dict[str, Fraction],
    also: Sequence[Column] = (),
) -> DataFrame:
    """A row per group: ``by``, the aggregates ``also``, and per fraction the value at that place.

    The largest value whose percent rank within the group is within the fraction, NULLs
    first, as in ``order_statistics``. NULL is a group. Of a floating column minus infinity is
    the lowest value, NaN the highest. A group may hold all rows, all groups one row each;
    an empty table gives no rows.
    """
    kind = df.schema[column].dataType
    own, positions = quoted(column), list(fractions.values())
    keys = {name: f"g{i}_" for i, name in enumerate(by)}
    finite = _finite(own, kind)
    floating = isinstance(kind, (T.DoubleType, T.FloatType))
    least = F.count_if(own == float("-inf")) if floating else F.lit(0).cast("bigint")
    endless = F.count_if(own == float("inf")) if floating else F.lit(0).cast("bigint")
    extremes = (F.min(finite).alias("low_"), F.max(finite).alias("high_"))
    groups = df.groupBy(*(quoted(name).alias(alias) for name, alias in keys.items())).agg(
        *(c.alias(f"also{i}_") for i, c in enumerate(also)),
        F.count(F.lit(1)).alias("rows_"),
        (F.count(F.lit(1)) - F.count(own)).alias("nulls_"),
        F.count(finite).alias("finite_"),
        least.alias("least_"),
        endless.alias("endless_"),
        *extremes,
    )
    # Places among the finite values; others are settled by the counts alone.
    before = F.col("nulls_") + F.col("least_")
    for i, f in enumerate(positions):
        place = F.expr(f"(rows_ - 1) * {f.numerator}L div {f.denominator}L")
        groups = groups.withColumn(f"at{i}_", place - before)
    groups = kept(groups)
    named = list(keys.values())
    sought = [F.col(f"at{i}_") for i in range(len(positions))]
    places = groups.select(*named, *sought)
    spans = groups.where("finite_ > 0").select(
        *named, "low_", "high_", F.lit(0).cast("bigint").alias("below_"), F.col("finite_").alias("n_")
    )
    values = df.select(*(quoted(name).alias(alias) for name, alias in keys.items()), finite.alias("v_"))
    values = values.where("v_ IS NOT NULL")
    settled = None
    while True:
        open_ = (F.col("low_") != F.col("high_")) & (F.col("n_") > FINAL_ROWS)
        wide, narrow = spans.where(open_), spans.where(~open_)
        settled = narrow if settled is None else settled.unionByName(narrow)
        if wide.isEmpty():
            break
        parts = _parts(values, wide, named, kind)
        held = parts.join(_named(places, "of_"), _same(named, "of_")).where(
            " or ".join(f"at{i}_ between below_ and below_ + n_ - 1" for i in range(len(positions)))
        )
        new = kept(held.select(*named, "low_", "high_", "below_", "n_", "whole_"))
        # Parts as large as what was cut: values closer together than doubles can tell.
        stuck = (F.col("n_") == F.col("whole_")) & (F.col("n_") > FINAL_ROWS)
        settled = settled.unionByName(new.where(stuck).drop("whole_"))
        spans = new.where(~stuck).drop("whole_")
    return _settle(df, by, keys, groups, values, settled, fractions, also, kind, column)


def _named(df: DataFrame, prefix: str) -> DataFrame:
    """Group columns (g0_, ...) under other names, for joins on them."""
    renamed = [F.col(c).alias(f"{prefix}{c}") if c.startswith("g") else F.col(c) for c in df.columns]
    return df.select(*renamed)


def _same(names: Sequence[str], prefix: str) -> list[Column]:
    return [F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in names]


def _within(values: DataFrame, spans: DataFrame, named: Sequence[str]) -> DataFrame:
    """Values with the interval of their group that holds them."""
    inside = (F.col("v_") >= F.col("low_")) & (F.col("v_") <= F.col("high_"))
    return values.join(_named(spans, "of_"), [*_same(named, "of_"), inside])


def _parts(
    values: DataFrame, spans: DataFrame, named: Sequence[str], kind: T.DataType
) -> DataFrame:
    """The intervals cut into equal parts, each as tight as its values, with counts below."""
    bins = measures.BINS
    low, high, v = (_number(F.col(c), kind) for c in ("low_", "high_", "v_"))
    scaled = F.floor((v - low) / F.nullif(high - low, F.lit(0.0)) * bins)
    part = F.least(F.coalesce(scaled, F.lit(0)), F.lit(bins - 1)).cast("int")
    found = _within(values, spans, named).select(
        *named, F.col("low_").alias("from_"), F.col("below_").alias("start_"),
        F.col("n_").alias("whole_"), part.alias("part_"), "v_",
    )
    counted = found.groupBy(*named, "from_", "start_", "whole_", "part_").agg(
        F.count(F.lit(1)).alias("n_"), F.min("v_").alias("low_"), F.max("v_").alias("high_")
    )
    earlier = (
        W.partitionBy(*named, "from_").orderBy("part_").rowsBetween(W.unboundedPreceding, -1)
    )
    below = F.col("start_") + F.coalesce(F.sum("n_").over(earlier), F.lit(0))
    return counted.withColumn("below_", below)


def _settle(
    df: DataFrame,
    by: Sequence[str],
    keys: dict[str, str],
    groups: DataFrame,
    values: DataFrame,
    spans: DataFrame,
    fractions: dict[str, Fraction],
    also: Sequence[Column],
    kind: T.DataType,
    column: str,
) -> DataFrame:
    """The value at each place, from intervals of one value and of few rows."""
    named = list(keys.values())
    single = spans.where("low_ = high_").select(*named, F.col("low_").alias("v_"), "below_")
    each = _within(values, spans.where("low_ != high_"), named)
    counted = each.groupBy(*named, "low_", "below_", "v_").agg(F.count(F.lit(1)).alias("n_"))
    earlier = W.partitionBy(*named, "low_").orderBy("v_").rowsBetween(W.unboundedPreceding, -1)
    before = F.col("below_") + F.coalesce(F.sum("n_").over(earlier), F.lit(0))
    ordered = counted.select(*named, "v_", before.alias("below_")).unionByName(single)
    # Values of all intervals of a group: a few thousand rows at most, largest per place.
    places = groups.select(*named, *(f"at{i}_" for i in range(len(fractions))))
    found = (
        ordered.join(_named(places, "of_"), _same(named, "of_"))
        .groupBy(*named)
        .agg(
            *(
                F.expr(f"max(v_) filter (where below_ <= at{i}_)").alias(f"x{i}_")
                for i in range(len(fractions))
            )
        )
    )
    whole = groups.join(_named(found, "of_"), _same(named, "of_"), "left")
    out = [F.col(alias).alias(name) for name, alias in keys.items()]
    out += [F.col(f"also{i}_").alias(name) for i, name in enumerate(_names(df, by, also))]
    for i, name in enumerate(fractions):
        at = F.col(f"at{i}_")
        value = F.when((at >= 0) & (at < F.col("finite_")), F.col(f"x{i}_"))
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            low = (at < 0) & (at >= -F.col("least_"))
            high = F.col("finite_") + F.col("endless_")
            value = (
                F.when(low, F.lit(float("-inf")))
                .when((at >= F.col("finite_")) & (at < high), F.lit(float("inf")))
                .when(at >= high, F.lit(float("nan")))
                .otherwise(value)
            )
        out.append(value.cast(kind).alias(name))
    return whole.select(*out)


def _names(df: DataFrame, by: Sequence[str], also: Sequence[Column]) -> list[str]:
    """The names that the aggregates carry."""
    return df.groupBy().agg(*also).columns if also else []

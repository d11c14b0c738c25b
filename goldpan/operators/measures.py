"""Profiles of numeric measures."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from goldpan.functions import mean
from goldpan.functions.moments import deviation_of, variation_of
from goldpan.operators import ranking
from goldpan.operators.quality import quoted

# Equal parts that an interval of values is counted in.
BINS = 4096
# Rows of an interval that are put in order rather than counted once more.
FINAL_ROWS = 10_000


def average(column: str, digits: int = 2) -> Column:
    """Average rounded half away from zero; NULL without values."""
    return mean(f"sum({column})", f"count({column})", digits)


def deviation(column: str, digits: int = 2, kind: T.DataType | None = None) -> Column:
    """Sample standard deviation; NULL for fewer than two values.

    Exact where ``kind``, the column's type, is that of whole numbers or decimals.
    """
    return deviation_of(column, digits, kind)


def variation_pct(column: str, digits: int = 2, kind: T.DataType | None = None) -> Column:
    """Coefficient of variation in percent; NULL for a zero mean."""
    return variation_of(column, digits, kind)


def order_statistics(
    df: DataFrame, column: str, fractions: dict[str, Fraction], also: Sequence[Column] = ()
) -> DataFrame:
    """One row holding, per fraction, the largest value whose percent rank is within it.

    Percent rank is (rows before) / (rows - 1), NULLs first, so this is the value at
    position floor(fraction * (rows - 1)) of the sorted rows: the lower order statistic,
    not an interpolated percentile. Of a floating column minus infinity is the lowest value and
    NaN the highest. ``also`` are aggregates of the same rows, in front.

    Exact without sorting the column. One pass takes the counts, the extremes and
    ``also``. The interval between the extremes is counted in equal parts, partial sums per
    task, and the parts that hold a position are counted anew until few rows are left in
    them or one value. The driver sees a bounded number of counts; only those last rows are
    put in order.
    """
    field = df.schema[column]
    own = quoted(column)
    floating = isinstance(field.dataType, (T.DoubleType, T.FloatType))
    ends = [float("-inf"), float("inf"), float("nan")] if floating else []
    finite = F.when(~F.isnan(own) & (F.abs(own) < ends[1]), own) if floating else own
    counts = [F.count(F.lit(1)), F.count(own), F.count(finite), F.min(finite), F.max(finite)]
    counts += [F.count_if(own == end) for end in ends]
    pass_one = df.agg(*also, *(c.alias(f"own_{i}_") for i, c in enumerate(counts)))
    seen = pass_one.first()
    rows, present, inner, low, high, *outer = seen[len(also) :]
    wanted = {name: math.floor(f * (rows - 1)) - (rows - present) for name, f in fractions.items()}
    lowest = outer[0] if outer else 0
    sought = sorted({at for at in wanted.values() if lowest <= at < lowest + inner})
    values = df.select(finite.alias(column)) if floating else df.select(own)
    found = _values_at(values, field, sought, Span(low, high, inner, lowest))
    if outer:
        for at in wanted.values():
            if 0 <= at < lowest:
                found[at] = ends[0]
            elif lowest + inner <= at:
                found[at] = ends[1] if at < lowest + inner + outer[1] else ends[2]
    shape = [*pass_one.schema.fields[: len(also)]]
    shape += [T.StructField(name, field.dataType) for name in wanted]
    row = (*seen[: len(also)], *(found.get(at) for at in wanted.values()))
    return df.sparkSession.createDataFrame([row], T.StructType(shape))


@dataclass(frozen=True)
class Span:
    """An interval of values, how many rows lie in it and how many below it."""

    low: object
    high: object
    rows: int
    below: int

    def holds(self, position: int) -> bool:
        return self.below <= position < self.below + self.rows

    def condition(self, column: str, kind: str) -> str:
        return f"{column} between cast('{self.low}' as {kind}) and cast('{self.high}' as {kind})"


def _values_at(
    values: DataFrame, field: T.StructField, sought: Sequence[int], whole: Span
) -> dict[int, object]:
    """The value at each position in the order of the values that are not NULL."""
    kind = field.dataType.simpleString()
    name = "`" + field.name.replace("`", "``") + "`"
    spans = [whole] if sought else []
    while spans:
        wide = [s for s in spans if s.low != s.high and s.rows > min(FINAL_ROWS, ranking.SINGLE_TASK_ROWS)]
        if not wide:
            break
        parts = _parts(values, field, name, kind, wide)
        kept = {p for p in parts if any(p.holds(at) for at in sought)}
        narrower = kept - set(wide)
        spans = sorted({s for s in spans if s not in wide} | kept, key=lambda s: s.below)
        if not narrower:  # closer together than a double can tell
            break
    found = {at: s.low for s in spans for at in sought if s.low == s.high and s.holds(at)}
    left = [s for s in spans if s.low != s.high]
    if not left:
        return found
    number = "".join(f" when {s.condition(name, kind)} then {i}" for i, s in enumerate(left))
    candidates = values.withColumn("span_", F.expr(f"case{number} end")).where("span_ is not null")
    most = sum(s.rows for s in left)
    places = ranking.order_positions(candidates, field.name, most, ["span_"])
    below = "".join(f" when {i} then {s.below}L" for i, s in enumerate(left))
    placed = places.withColumn("before_", F.expr(f"rows_before + case span_{below} end"))
    open_ = [at for at in sought if at not in found]
    picked = placed.selectExpr(
        *[f"max({name}) filter (where before_ <= {at}) as at{i}" for i, at in enumerate(open_)]
    ).first()
    return found | dict(zip(open_, picked))


def _parts(
    values: DataFrame, field: T.StructField, name: str, kind: str, spans: Sequence[Span]
) -> list[Span]:
    """The spans cut into equal parts, those with rows, each as tight as its values."""
    dated = isinstance(field.dataType, T.DateType)
    # Halves, so that the gap between the largest doubles is one too.
    number = f"double({f'unix_date({name})' if dated else name}) / 2"
    which, part = "", ""
    for i, s in enumerate(spans):
        low, high = (f"double({f'unix_date({x})' if dated else x}) / 2" for x in (
            f"cast('{s.low}' as {kind})", f"cast('{s.high}' as {kind})"))
        scaled = f"floor(({number} - ({low})) / nullif(({high}) - ({low}), 0D) * {BINS})"
        which += f" when {s.condition(name, kind)} then {i}"
        part += f" when {i} then least(coalesce({scaled}, 0), {BINS - 1})"
    # In order of the parts: a larger value never has a smaller part.
    counted = (
        values.selectExpr(f"{name} as v", f"case{which} end as s")
        .where("s is not null")
        .withColumnRenamed("v", field.name)
        .selectExpr(f"{name} as v", "s", f"case s{part} end as p")
        .groupBy("s", "p")
        .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    )
    out = []
    below = {i: s.below for i, s in enumerate(spans)}
    for r in sorted(counted.collect(), key=lambda r: (r["s"], r["p"])):
        out.append(Span(r["low"], r["high"], r["n"], below[r["s"]]))
        below[r["s"]] += r["n"]
    return out

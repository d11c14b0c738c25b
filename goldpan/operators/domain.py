"""Domains of categorical columns and shares of a total."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldpan.functions import percent
from goldpan.operators.magnitudes import Metric
from goldpan.operators.ranking import SINGLE_TASK_ROWS, settled


def domain(df: DataFrame, column: str, name: str, collation: str | None = None) -> DataFrame:
    """Every value a column takes, NULL included, in order.

    Text compares exactly unless ``collation`` names a laxer rule (``UTF8_LCASE``,
    ``UTF8_LCASE_RTRIM``). Spellings that compare equal are then one value, shown by
    its smallest spelling.
    """
    value = F.col(column)
    if collation is None:
        return df.select(value.alias(name)).distinct().orderBy(name)
    merged = df.groupBy(F.collate(value, collation).alias("same")).agg(F.min(value).alias(name))
    return merged.select(name).orderBy(name)


def one_spelling(
    groups: DataFrame, columns: Sequence[str], metrics: Sequence[Metric], collation: str
) -> DataFrame:
    """Groups whose attributes compare equal under a collation as one, shown by the smallest spelling.

    ``metrics`` are counts and sums that the groups hold already; they add up, so the facts are
    summed by exact spelling first and only groups meet. NULL is a value of its own.
    """
    if any(m.kind == "distinct" for m in metrics):
        raise ValueError("distinct counts of groups do not add up")
    same = [F.collate(F.col(c), collation).alias(f"same{i}_") for i, c in enumerate(columns)]
    shown = [F.min(c).alias(c) for c in columns]
    merged = groups.groupBy(*same).agg(*shown, *(m.over_partials() for m in metrics))
    return merged.drop(*(f"same{i}_" for i in range(len(columns))))


def value_counts(
    df: DataFrame, columns: Sequence[str], name: str, counted: str | None = None
) -> DataFrame:
    """Rows (or non-NULL ``counted``) per combination present; absent ones stay absent."""
    return df.groupBy(*columns).agg(F.count(counted or "*").alias(name))


def with_share(groups: DataFrame, measure: str, name: str, rows: int) -> DataFrame:
    """Add each group's percentage of the measure's total over all groups.

    ``rows`` bounds the number of groups. Few enough pass through one window; more are
    written once and their total, a partial sum per task, is read back as a scalar.
    """
    groups, rows = settled(groups, rows)
    if rows <= SINGLE_TASK_ROWS:
        total = F.expr(f"sum({measure}) over ()")
    else:
        total = groups.agg(F.sum(measure)).scalar()
    totalled = groups.withColumn("grand_total", total)
    return totalled.withColumn(name, percent(measure, "grand_total")).drop("grand_total")

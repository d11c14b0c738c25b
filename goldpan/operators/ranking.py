"""Ranks over groups.

A ranking without partitions needs one total order. Where the number of ranked rows is
known to be small a plain window does it in one task. Beyond that the engine cuts the order
into ranges, each range is ordered by its own task, and each starts from the exact count of
what lies before it.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from goldpan.sources.storage import cut_lineage, kept

# Rows one task may order by itself.
SINGLE_TASK_ROWS = 1_000_000

# Up to this many rows a group, a filter on ranks limits each group before rows are shuffled.
GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"

METHODS = {"dense_rank": F.dense_rank, "rank": F.rank, "row_number": F.row_number}


def direction(column: str, descending: bool) -> Column:
    """NULLs come first ascending and last descending."""
    return F.col(column).desc() if descending else F.col(column).asc()


def settled(groups: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """Groups with a bound on their number, computed once where the bound is a high one.

    Written groups can be counted, and the count, often far below the bound (countries
    against customers), decides how they are ranked.
    """
    if rows <= SINGLE_TASK_ROWS:
        return groups, rows
    groups = cut_lineage(groups)
    return groups, groups.count()


def leaderboard(
    groups: DataFrame,
    measure: str,
    k: int,
    rank: str,
    ties: Sequence[str],
    descending: bool = True,
    method: str = "dense_rank",
) -> DataFrame:
    """The first ``k`` rows by ``measure``, ranked; ``ties`` order rows of equal measure.

    A rank depends only on the rows above, so the rows are limited first (each task
    keeps its best ``k``) and only those ``k`` reach the ranking window.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}: one of {', '.join(METHODS)}")
    order = [direction(measure, descending)]
    top = groups.orderBy(*order, *ties).limit(k)
    over = W.orderBy(*order, *ties) if method == "row_number" else W.orderBy(*order)
    return top.withColumn(rank, METHODS[method]().over(over)).orderBy(rank, *ties)


def with_rank(
    groups: DataFrame,
    measure: str,
    rank: str,
    rows: int,
    partition_by: Sequence[str] = (),
    descending: bool = True,
    method: str = "dense_rank",
    ties: Sequence[str] = (),
) -> DataFrame:
    """Rank every row by ``measure``, overall or within partitions.

    ``rows`` is a bound on the number of rows ranked. ``method`` is ``dense_rank``, ``rank``
    or ``row_number``; rows of equal measure are numbered in order of ``ties``, which should
    tell all rows apart.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}: one of {', '.join(METHODS)}")
    order = direction(measure, descending)
    if method == "row_number":
        order = [order, *(F.col(c) for c in ties)]
        if rows > SINGLE_TASK_ROWS:
            return numbered(groups, partition_by, order, rank)
    if rows <= SINGLE_TASK_ROWS:
        over = W.partitionBy(*partition_by).orderBy(order)
        return groups.withColumn(rank, METHODS[method]().over(over))
    before = {"dense_rank": "values_before", "rank": "rows_before"}[method]
    kept = groups.columns
    positions = order_positions(groups, measure, rows, partition_by, descending)
    keys = [*partition_by, measure]
    for c in keys:
        positions = positions.withColumnRenamed(c, f"at_{c}")
    match = [F.col(c).eqNullSafe(F.col(f"at_{c}")) for c in keys]
    return groups.join(positions, match).select(*kept, (F.col(before) + 1).alias(rank))


def best_per_group(
    groups: DataFrame,
    measure: str,
    k: int,
    rank: str,
    partition_by: Sequence[str],
    rows: int,
    ties: Sequence[str],
    descending: bool = True,
    method: str = "dense_rank",
) -> DataFrame:
    """The rows of the first ``k`` ranks of each group, ranked.

    ``row_number`` gives ``k`` rows a group, numbered among equals in order of ``ties``; the
    ranks keep all that tie. ``rows`` is a bound on the number of rows ranked. A filter on a
    window's rank limits each group within each task before rows are shuffled, so a group of
    any size sends ``k`` rows a task. Ties have no such bound: beyond what one task may
    order, ranks are found among the distinct values of a group, of which ``k`` are left, and
    rows look theirs up in a join that can be split.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}: one of {', '.join(METHODS)}")
    order = direction(measure, descending)
    limited = int(groups.sparkSession.conf.get(GROUP_LIMIT, "1000"))
    if k > limited and rows > SINGLE_TASK_ROWS:  # groups are not limited by task any more
        ranked = with_rank(groups, measure, rank, rows, partition_by, descending, method, ties)
        return ranked.where(F.col(rank) <= k)
    if method == "row_number":
        over = W.partitionBy(*partition_by).orderBy(order, *ties)
        return groups.withColumn(rank, F.row_number().over(over)).where(F.col(rank) <= k)
    over = W.partitionBy(*partition_by).orderBy(order)
    if rows <= SINGLE_TASK_ROWS:
        return groups.withColumn(rank, METHODS[method]().over(over)).where(F.col(rank) <= k)
    values = groups.groupBy(*partition_by, measure).agg(F.count(F.lit(1)).alias("rows_at_"))
    best = values.withColumn("place_", F.dense_rank().over(over)).where(F.col("place_") <= k)
    if method == "rank":
        earlier = F.coalesce(F.sum("rows_at_").over(_earlier(W.partitionBy(*partition_by), order)), F.lit(0))
        best = best.withColumn("place_", earlier + 1).where(F.col("place_") <= k)
    keys = [*partition_by, measure]
    found = best.select(*(F.col(c).alias(f"at{i}_") for i, c in enumerate(keys)), "place_")
    match = [groups[c].eqNullSafe(found[f"at{i}_"]) for i, c in enumerate(keys)]
    place = F.col("place_").cast("int").alias(rank)
    return groups.join(found, match).select(*(groups[c] for c in groups.columns), place)


def with_percent_rank(
    df: DataFrame, measure: str, name: str, partition_by: Sequence[str] = ()
) -> DataFrame:
    """Adds PERCENT_RANK of every row: rows before it over all other rows, 0 for a row alone.

    NULLs come first and are ranked. Rows are counted per value and values cut into ranges,
    so that no group, however large, is ordered by one task; rows get their place in a join by
    value, which can be split where a value has many rows.
    """
    keys = [*partition_by, measure]
    named = [f"at{i}_" for i in range(len(keys))]
    groups, value = named[:-1], named[-1]
    values = df.groupBy(*(F.col(c).alias(a) for c, a in zip(keys, named))).agg(
        F.count(F.lit(1)).alias("rows_at_")
    )
    dealt = values.repartitionByRange(*named).withColumn("range_", F.spark_partition_id())
    dealt = kept(dealt)
    counts = dealt.groupBy(*groups, "range_").agg(F.sum("rows_at_").alias("n_"))
    starts = _range_starts(counts, groups)
    inside = F.coalesce(F.sum("rows_at_").over(_earlier(W.partitionBy(*groups, "range_"), F.col(value))), F.lit(0))
    local = dealt.withColumn("inside_", inside)
    same = [local[c].eqNullSafe(starts[c]) for c in [*groups, "range_"]]
    places = local.join(starts, same).select(
        *(local[c] for c in named),
        F.when(F.col("all_") == 1, F.lit(0.0))
        .otherwise((F.col("start_") + F.col("inside_")).cast("double") / (F.col("all_") - 1))
        .alias("place_"),
    )
    match = [df[c].eqNullSafe(places[a]) for c, a in zip(keys, named)]
    return df.join(places, match).select(*(df[c] for c in df.columns), F.col("place_").alias(name))


def _range_starts(counts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Per group and range: rows before it (``start_``) and rows of the group (``all_``).

    Without groups there is a row per task: these are added up by the client.
    """
    if groups:
        by = W.partitionBy(*groups)
        start = F.coalesce(F.sum("n_").over(_earlier(by, F.col("range_"))), F.lit(0))
        return counts.select(*groups, "range_", start.alias("start_"), F.sum("n_").over(by).alias("all_"))
    held = sorted(tuple(r) for r in counts.select("range_", "n_").collect())
    before = [0, *accumulate(n for _, n in held)]
    found = [(at, start, before[-1]) for (at, _), start in zip(held, before)]
    shape = "range_ int, start_ bigint, all_ bigint"
    return F.broadcast(counts.sparkSession.createDataFrame(found, shape))


def numbered(
    df: DataFrame, partition_by: Sequence[str], order: Sequence[Column], name: str
) -> DataFrame:
    """Number rows from 1 in a total order, each range of it by its own task.

    The engine samples the ranges. They are checkpointed with their number, so that every
    later job sees the same, and each starts from the count of rows before it.
    """
    kept, groups = df.columns, [F.col(c) for c in partition_by]
    dealt = df.repartitionByRange(*groups, *order).withColumn("range_", F.spark_partition_id())
    dealt = cut_lineage(dealt)
    counts = dealt.groupBy(*groups, "range_").agg(F.count(F.lit(1)).alias("rows_"))
    earlier = _earlier(W.partitionBy(*groups), F.col("range_"))
    starts = counts.withColumn("start_", F.coalesce(F.sum("rows_").over(earlier), F.lit(0)))
    inside = F.row_number().over(W.partitionBy(*groups, "range_").orderBy(*order))
    local = dealt.withColumn("local_", inside)
    match = [local[c].eqNullSafe(starts[c]) for c in [*partition_by, "range_"]]
    found = local.join(starts, match)
    return found.select(*(local[c] for c in kept), (F.col("start_") + F.col("local_")).alias(name))


def order_positions(
    df: DataFrame,
    column: str,
    rows: int,
    partition_by: Sequence[str] = (),
    descending: bool = False,
) -> DataFrame:
    """Per distinct value: how many rows and how many distinct values come before it.

    Rows are counted per value first, so a value shared by a third of the rows is one
    row from there on. NULL is a value. ``rows`` bounds the row count of ``df``.
    """
    values = df.groupBy(*partition_by, column).agg(F.count(F.lit(1)).alias("rows_at"))
    if rows <= SINGLE_TASK_ROWS:
        earlier = _earlier(W.partitionBy(*partition_by), direction(column, descending))
        return values.select(
            *partition_by,
            column,
            "rows_at",
            F.coalesce(F.sum("rows_at").over(earlier), F.lit(0)).alias("rows_before"),
            F.count(F.lit(1)).over(earlier).alias("values_before"),
        )
    # The engine samples the ranges; checkpointed with their number they stay the same.
    order = direction(column, descending)
    dealt = values.repartitionByRange(*(F.col(c) for c in partition_by), order)
    values = cut_lineage(dealt.withColumn("stretch", F.spark_partition_id()))
    per_stretch = values.groupBy(*partition_by, "stretch").agg(
        F.sum("rows_at").alias("stretch_rows"), F.count(F.lit(1)).alias("stretch_values")
    )
    earlier = _earlier(W.partitionBy(*partition_by), F.col("stretch"))
    starts = per_stretch.select(
        *[F.col(c).alias(f"of_{c}") for c in partition_by],
        F.col("stretch").alias("of_stretch"),
        F.coalesce(F.sum("stretch_rows").over(earlier), F.lit(0)).alias("rows_start"),
        F.coalesce(F.sum("stretch_values").over(earlier), F.lit(0)).alias("values_start"),
    )
    match = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in [*partition_by, "stretch"]]
    earlier = _earlier(W.partitionBy(*partition_by, "stretch"), direction(column, descending))
    inside = F.coalesce(F.sum("rows_at").over(earlier), F.lit(0))
    return values.join(starts, match).select(
        *partition_by,
        column,
        "rows_at",
        (F.col("rows_start") + inside).alias("rows_before"),
        (F.col("values_start") + F.count(F.lit(1)).over(earlier)).alias("values_before"),
    )


def _earlier(partition, order: Column):
    return partition.orderBy(order).rowsBetween(W.unboundedPreceding, -1)

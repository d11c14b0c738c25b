"""What several operators share: reading a table, and order without one task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from goldpan.sources.storage import new_folder, written

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
# Rows of text handed to a Python task at once, at most this many bytes (and one row at least).
SLICE_BYTES = 16 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder: later reads recompute nothing."""
    return written(df, new_folder(df.sparkSession))


def stored_at(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows, written once, and the folder they lie in: for those who delete it later."""
    folder = new_folder(df.sparkSession)
    return written(df, folder), folder


def deleted(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that an operator wrote and that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Python tuples of some columns, a bounded slice of a batch at a time.

    A batch may hold thousands of long texts; only a slice of them exists twice.
    """
    for batch in batches:
        per_row = max(1, batch.nbytes // max(1, batch.num_rows))
        step = max(1, SLICE_BYTES // per_row)
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield from zip(*(part.column(name).to_pylist() for name in columns))


def batched(
    records: Iterator[tuple], schema: pa.Schema, size: int = 2000, limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows and about ``limit`` bytes of text or blobs."""
    held: list[tuple] = []
    weight = 0
    for record in records:
        held.append(record)
        weight += sum(len(x) for x in record if isinstance(x, (str, bytes, list)))
        if len(held) >= size or weight >= limit:
            yield _batch(held, schema)
            held, weight = [], 0
    if held:
        yield _batch(held, schema)


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(x, f.type) for x, f in zip(zip(*held), schema)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def numbered(df: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """Adds a gapless number from 0 within each group, in the given order.

    Rows are cut into ranges of (group, order), each numbered on its own, starting from
    the count of the group's rows in earlier ranges. No group has to fit one task, and
    since the input position is the last sort key neither do rows alike in every column.
    The frame should be narrow: it is written once.
    """
    place = df.withColumn("_at", F.monotonically_increasing_id())
    ranged = stored(
        place.repartitionByRange(*groups, *order, "_at").withColumn(
            "_range", F.spark_partition_id()
        )
    )
    earlier = Window.partitionBy(*groups).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    counts = ranged.groupBy("_range", *groups).agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    inside = Window.partitionBy("_range", *groups).orderBy(*order, "_at")
    local = ranged.withColumn("_local", F.row_number().over(inside) - 1)
    same = [local[c].eqNullSafe(starts[c]) for c in ["_range", *groups]]
    return local.join(starts, same).select(
        *(local[c] for c in df.columns), (F.col("_start") + F.col("_local")).alias(name)
    )


def quoted(name: str) -> str:
    """A column's name for lookups, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def by_place(df: DataFrame) -> DataFrame:
    """The frame with columns named c0, c1, ...: tasks take names without dots or quotes only."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; none for NULL."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")

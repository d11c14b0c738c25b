"""Column profiles that add up, kept per source file.

Of every column of every file the store holds counts, extremes, and two sketches as binary
values: HyperLogLog for distinct values, KLL for quantiles. All of them merge, so a table's
profile is that of its files' states, and after files have come only those are read.
States of files that are gone or were written anew are not merged any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from goldpan.operators.quality import quoted
from goldpan.sources.storage import new_folder

# Sketch sizes: distinct values within some 2.5 % (one in twenty beyond 5 %), ranks within 1.4 %.
HLL_BITS, KLL_ITEMS = 12, 200

STATE = (
    "file string, modified timestamp, size bigint, column_name string, row_count bigint, "
    "null_count bigint, lowest double, highest double, first_text string, last_text string, "
    "longest bigint, distinct_state binary, quantile_state binary"
)
FILE = ["file", "modified", "size"]
SKETCHED = (T.IntegerType, T.LongType, T.StringType, T.BinaryType)


def _files(source: DataFrame) -> DataFrame:
    """The files of a table with time and size; they are listed, not read."""
    names = source.inputFiles()
    reader = source.sparkSession.read.format("binaryFile")
    if not names:
        return source.sparkSession.createDataFrame([], "file string, modified timestamp, size bigint")
    return reader.load(names).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_modification_time").alias("modified"),
        F.col("_metadata.file_size").alias("size"),
    )


def _states(store: str, spark: SparkSession) -> DataFrame:
    return spark.read.schema(STATE).parquet(store)


def refresh(source: DataFrame, store: str) -> list[str]:
    """Adds the states of files that the store does not have; returns these files.

    ``source`` is a table of Parquet files. The store is a folder that every node sees; a
    refresh that fails leaves it as it was.
    """
    spark = source.sparkSession
    spark.createDataFrame([], STATE).write.mode("append").parquet(store)
    known = _states(store, spark).select(*FILE).distinct()
    new = [r["file"] for r in _files(source).join(known, FILE, "left_anti").collect()]
    if new:
        rows = spark.read.schema(source.schema).parquet(*new)
        _profiled(rows).write.mode("append").parquet(store)
    return sorted(new)


def _profiled(rows: DataFrame) -> DataFrame:
    """A state per file and column, all of them from one scan."""
    fields = rows.schema.fields
    wide, states = [F.count(F.lit(1)).alias("rows_")], []
    for i, field in enumerate(fields):
        own, kind = quoted(field.name), field.dataType
        number = isinstance(kind, T.NumericType)
        plain = isinstance(kind, T.AtomicType)
        text = own.cast("string") if plain and not number else F.lit(None).cast("string")
        value = own.cast("double") if number else F.lit(None).cast("double")
        hashed = own if isinstance(kind, SKETCHED) else own.cast("string")
        if not plain:
            hashed = F.to_json(F.struct(own))
        hashed = F.when(own.isNotNull(), hashed)
        wide += [
            (F.count(F.lit(1)) - F.count(own)).alias(f"nulls{i}"),
            F.min(value).alias(f"low{i}"),
            F.max(value).alias(f"high{i}"),
            F.min(text).alias(f"first{i}"),
            F.max(text).alias(f"last{i}"),
            F.max(F.char_length(text)).cast("bigint").alias(f"longest{i}"),
            F.hll_sketch_agg(hashed, HLL_BITS).alias(f"hll{i}"),
            # A sketch of nothing can be merged but not asked.
            F.when(F.count(value) > 0, F.kll_sketch_agg_double(value, KLL_ITEMS)).alias(f"kll{i}"),
        ]
        states.append(
            F.struct(
                F.lit(field.name).alias("column_name"),
                F.col("rows_").alias("row_count"),
                F.col(f"nulls{i}").alias("null_count"),
                F.col(f"low{i}").alias("lowest"),
                F.col(f"high{i}").alias("highest"),
                F.col(f"first{i}").alias("first_text"),
                F.col(f"last{i}").alias("last_text"),
                F.col(f"longest{i}").alias("longest"),
                F.col(f"hll{i}").alias("distinct_state"),
                F.col(f"kll{i}").alias("quantile_state"),
            )
        )
    file = [
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_modification_time").alias("modified"),
        F.col("_metadata.file_size").alias("size"),
    ]
    return rows.groupBy(*file).agg(*wide).select(*FILE, F.inline(F.array(*states)))


def merged(source: DataFrame, store: str) -> DataFrame:
    """A row per column of the table: exact counts and extremes, estimates from the sketches.

    Read from the states of the present files alone, a row per file and column. A column without
    values has NULLs and an estimate of 0; a table without files has no rows.
    """
    present = _states(store, source.sparkSession).join(_files(source), FILE, "left_semi")
    median = F.expr("kll_sketch_get_quantile_double(kll_merge_agg_double(quantile_state), 0.5D)")
    return present.groupBy("column_name").agg(
        F.sum("row_count").alias("row_count"),
        F.sum("null_count").alias("null_count"),
        F.min("lowest").alias("lowest"),
        F.max("highest").alias("highest"),
        F.min("first_text").alias("first_text"),
        F.max("last_text").alias("last_text"),
        F.max("longest").alias("longest"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_state")).alias("distinct_estimate"),
        F.when(F.count("quantile_state") > 0, median).alias("median_estimate"),
    )


_stores: dict[tuple[str, str], str] = {}


def profile(source: DataFrame, name: str) -> DataFrame:
    """The merged profile of a table, from a store of this session's that only grows by new files."""
    spark = source.sparkSession
    key = (spark.sparkContext.applicationId, name)
    if key not in _stores:
        _stores[key] = new_folder(spark)
    refresh(source, _stores[key])
    return merged(source, _stores[key])

"""Column audits and inventories: one scan per table, however many columns."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from goldpan.plans.star import Entry

# Measures of a column, as SQL over {c}.
NULL_COUNT = "count(*) - count({c})"
DISTINCT_COUNT = "count(distinct {c})"
APPROXIMATE_DISTINCT_COUNT = "approx_count_distinct({c})"


def column_audit(
    df: DataFrame, columns: Sequence[str], measure: str, label: str, value: str
) -> DataFrame:
    """``measure`` of every column as rows ``(label, value)``.

    All columns are aggregated together and the single result row is turned into
    rows, where one query per column would scan the table once per column.
    """
    wide = [F.expr(measure.format(c=name_of(c))).alias(f"m{i}") for i, c in enumerate(columns)]
    rows = [
        F.struct(F.lit(c).alias(label), F.col(f"m{i}").alias(value)) for i, c in enumerate(columns)
    ]
    return df.agg(*wide).select(F.inline(F.array(*rows)))


def name_of(column: str) -> str:
    """A column's exact name in SQL, whatever characters that has."""
    return "`" + column.replace("`", "``") + "`"


def column_dictionary(df: DataFrame, layer: str, name: str) -> DataFrame:
    """Declared position, type and nullability with measured longest text and NULL count."""
    wide, rows = [], []
    for i, field in enumerate(df.schema.fields):
        own = name_of(field.name)
        longest = F.expr(f"max(length({own}))" if isinstance(field.dataType, T.StringType) else "null")
        wide += [
            longest.cast("bigint").alias(f"length{i}"),
            F.expr(NULL_COUNT.format(c=own)).alias(f"nulls{i}"),
        ]
        described = {
            "schema_name": layer,
            "object_name": name,
            "col_position": i + 1,
            "column_name": field.name,
            "data_type": field.dataType.simpleString(),
        }
        told = [F.lit(v).alias(k) for k, v in described.items()]
        told[2] = F.lit(i + 1).cast("bigint").alias("col_position")
        rows.append(
            F.struct(
                *told,
                F.col(f"length{i}").alias("max_length"),
                F.lit("YES" if field.nullable else "NO").alias("is_nullable"),
                F.col(f"nulls{i}").alias("null_count"),
            )
        )
    return df.agg(*wide).select(F.inline(F.array(*rows)))


def row_counts(entries: Iterable[Entry]) -> DataFrame:
    """Layer, name, kind, column count and row count of every object, empty ones included.

    Rows carry only their object's number through one union into one aggregation;
    each task sends a single partial count per object.
    """
    entries = list(entries)
    spark = entries[0].df.sparkSession
    tagged = [entry.df.selectExpr(f"{i} as object") for i, entry in enumerate(entries)]
    counts = reduce(DataFrame.union, tagged).groupBy("object").agg(F.count("*").alias("n"))
    described = [
        F.struct(
            F.lit(i).alias("object"),
            F.lit(e.layer).alias("schema_name"),
            F.lit(e.name).alias("object_name"),
            F.lit(e.kind).alias("object_type"),
            F.lit(len(e.df.columns)).cast("bigint").alias("column_count"),
        )
        for i, e in enumerate(entries)
    ]
    objects = spark.range(1).select(F.inline(F.array(*described)))
    return objects.join(counts, "object", "left").selectExpr(
        "schema_name", "object_name", "object_type", "column_count", "coalesce(n, 0L) as row_count"
    )

"""Phase 1: what the warehouse holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldpan.operators.audit import column_dictionary, row_counts
from goldpan.plans.star import Star


def layer_inventory(star: Star) -> DataFrame:
    layers = row_counts(star.inventory).groupBy(F.col("schema_name"))
    return layers.agg(
        F.count(F.lit(1)).alias("object_count"), F.sum("row_count").alias("total_rows")
    ).orderBy("schema_name")


def object_inventory(star: Star) -> DataFrame:
    return row_counts(star.inventory).orderBy("schema_name", "object_type", "object_name")


def dictionary(star: Star) -> DataFrame:
    parts = [column_dictionary(df, "gold", name) for name, df in star.gold.items()]
    return reduce(DataFrame.unionByName, parts).orderBy("object_name", "col_position")


def gold_row_counts(star: Star) -> DataFrame:
    counts = row_counts(entry for entry in star.inventory if entry.layer == "gold")
    named = F.concat_ws(".", "schema_name", "object_name").alias("gold_object")
    return counts.select(named, "row_count").orderBy(F.desc("row_count"), "gold_object")

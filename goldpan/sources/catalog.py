"""A star whose objects already are tables or views of the session's catalog."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import SparkSession

from goldpan.plans.star import KEYS, Entry, Roles, Star
from goldpan.sources.storage import new_folder, written


def catalog_star(
    spark: SparkSession,
    gold: str = "gold",
    upstream: Sequence[str] = ("bronze", "silver"),
    roles: Roles | None = None,
) -> Star:
    """The five objects of a gold schema, with everything in the upstream schemas present."""

    def kinds(schema: str) -> dict[str, str]:
        return {
            t.name: "VIEW" if t.tableType == "VIEW" else "BASE TABLE"
            for t in spark.catalog.listTables(schema)
            if not t.isTemporary
        }

    entries = [
        Entry(schema, name, kind, spark.table(f"{schema}.{name}"))
        for schema in upstream
        if spark.catalog.databaseExists(schema)
        for name, kind in kinds(schema).items()
    ]
    return Star(
        **{name: spark.table(f"{gold}.{name}") for name in KEYS},
        roles=roles or Roles(),
        upstream=tuple(entries),
        kinds=kinds(gold),
    )


def materialized(star: Star) -> Star:
    """The star with its five objects written once below the shared folder.

    Worth it where they are views over joins, which every statement would run again.
    """
    folder = new_folder(star.fact_sales.sparkSession)
    stored = {name: written(df, f"{folder}/{name}") for name, df in star.gold.items()}
    return replace(star, **stored, _proofs={}, _rows={})

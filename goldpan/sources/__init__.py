"""Where tables come from: lake files, catalog schemas, and the gold star over them."""

from goldpan.sources.catalog import catalog_star, materialized
from goldpan.sources.gold import lake_star
from goldpan.sources.lake import read_csv, read_table

__all__ = ["catalog_star", "lake_star", "materialized", "read_csv", "read_table"]

"""Result typing."""

from __future__ import annotations

from pyspark.sql import DataFrame

_WHOLE = ("tinyint", "smallint", "int")


def result_types(df: DataFrame) -> DataFrame:
    """Widen the final columns: whole numbers to bigint, fractional ones to double."""

    def widen(name: str, kind: str) -> str:
        if kind in _WHOLE:
            return f"cast(`{name}` as bigint) as `{name}`"
        if kind == "float" or kind.startswith("decimal"):
            return f"cast(`{name}` as double) as `{name}`"
        return f"`{name}`"

    return df.selectExpr(*[widen(name, kind) for name, kind in df.dtypes])

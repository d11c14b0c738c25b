"""Row-by-row comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import datetime
import math

KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE"}


def canonical(value):
    if isinstance(value, datetime.datetime):
        return value.date().isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    lined = [tuple(canonical(row[i]) for i in order) for row in rows]
    return sorted(lined, key=lambda row: [(v is None, str(v)) for v in row])


def assert_same(df, con, sql):
    result = con.sql(sql)
    kinds = dict(zip(result.columns, map(str, result.types)))
    assert sorted(df.columns) == sorted(result.columns)
    assert {n: KINDS[t] for n, t in df.dtypes} == kinds
    ours = rows_of(df.columns, df.collect())
    theirs = rows_of(result.columns, result.fetchall())
    assert ours == theirs
    return ours

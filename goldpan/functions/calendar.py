"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_boundaries(start: str, end: str) -> Column:
    """Month starts crossed between two dates: Jan 31 to Feb 1 is 1.

    ``timestampdiff(MONTH, ...)`` counts whole elapsed months instead.
    """
    years = f"(year({end}) - year({start}))"
    return F.expr(f"cast({years} * 12 + month({end}) - month({start}) as bigint)")


def year_month(date: str) -> Column:
    """First day of the month: one value per year-month, NULL for NULL."""
    return F.trunc(date, "month")

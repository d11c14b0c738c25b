"""Exact ratios.

Averages, shares and rates are rounded half away from zero on integers, never on
doubles, so a value lying exactly on a half cent rounds the same way whatever the
partitioning of the data or the engine that checks it. Operands are SQL expressions.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"


def half_up(num: str, den: str, digits: int, integer: str = WIDE) -> Column:
    """``num / den`` of two whole numbers at ``digits`` decimals; NULL when ``den`` is 0.

    ``integer`` is the type the arithmetic runs in. The wide default suits totals of
    any size; ``bigint`` is the fast choice for one row's own values.
    """
    n = f"abs(cast({num} as {integer}))"
    d = f"nullif(abs(cast({den} as {integer})), 0)"
    size = f"(({2 * 10**digits} * {n} + {d}) div (2 * {d}))"
    sign = f"(case when (({num}) < 0) = (({den}) < 0) then 1 else -1 end)"
    unit = f"{Decimal(1).scaleb(-digits)}BD"
    return F.expr(f"cast(cast({sign} * {size} as decimal(20,0)) * {unit} as decimal(20,{digits}))")


# Decimals kept of money: enough for any usual money type, with room for totals to 10^22.
DECIMALS = 9
UNIT = 10**DECIMALS


def units(money: str) -> str:
    """A number of any type with at most nine decimals, as a whole number of billionths."""
    return f"cast(cast(({money}) as decimal(38,{DECIMALS})) * {UNIT}BD as {WIDE})"


def mean(total: str, count: str, digits: int = 2) -> Column:
    """Average from a sum and a row count."""
    return half_up(units(total), f"cast(({count}) as {WIDE}) * {UNIT}BD", digits)


def percent(part: str, whole: str, digits: int = 2) -> Column:
    """``part`` as a percentage of ``whole``."""
    return half_up(f"{units(part)} * 100", units(whole), digits)

"""Exact deviations from sums that add up.

Values are whole numbers of a decimal unit, cut in two parts of nine digits, high and low. A
group keeps its count, the sums of both parts and of their three products: whole numbers,
the same whatever order or partition they are added in. From them the squares around the
mean follow without cancellation, and their root is rounded by comparing whole numbers, never by
way of doubles. Everything is a built-in expression over one row per group.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from goldpan.functions.exact import WIDE

# Most digits of whole numbers by type.
DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}
PART = 10**9  # a part's values
EXTRA = 6  # further digits of a deviation that is divided again
FEW = 10**24  # squares of fewer digits get them


def deviation_of(column: str, digits: int, kind: T.DataType | None) -> Column:
    """Sample standard deviation, rounded half up; NULL for fewer than two values.

    Exact for whole numbers and decimals, while the variance
    has at most 31 and the sum of squares around the mean 37 digits of the unit: deviations
    up to some ten million millions of money in cents. Beyond, arithmetic overflows and says so. Columns of
    another or an unknown type give rounded doubles.
    """
    if type(kind) not in DIGITS and not isinstance(kind, T.DecimalType):
        return F.expr(f"round(stddev_samp({column}), {digits})")
    scale, sums = _sums(column, digits, kind)
    steps = [*_squares(), *_root(f"s.q + {_floor('s.e', 's.nn')}", 2 * (scale - digits))]
    rounded = f"cast({_div('s.root + 1', '2')} * {_unit(digits)} as decimal(30,{digits}))"
    return F.expr(_chain(sums, steps, rounded))


def variation_of(column: str, digits: int, kind: T.DataType | None) -> Column:
    """Deviation in percent of the mean; NULL for a zero mean or fewer than two values.

    The deviation, to at least twelve digits or six more than the unit's, is divided once.
    """
    if type(kind) not in DIGITS and not isinstance(kind, T.DecimalType):
        return F.expr(
            f"round(stddev_samp({column}) / nullif(avg({column}), 0) * 100, {digits})"
        )
    _, sums = _sums(column, digits, kind)
    # A root of many digits needs no further ones.
    finer = f"case when s.q < {FEW}BD then {10**EXTRA}BD else 1BD end"
    square = f"s.q * s.finer * s.finer + {_floor('s.e * s.finer * s.finer', 's.nn')}"
    steps = [*_squares(), {"finer": _wide(finer)}, *_root(square, 0)]
    steps.append({"mean": _wide("nullif(abs(s.total), 0) * 2 * s.finer")})
    size = _div(f"s.root * s.n * {200 * 10**digits}BD + s.mean", "2 * s.mean")
    share = f"cast(sign(s.total) * {size} * {_unit(digits)} as decimal(30,{digits}))"
    return F.expr(_chain(sums, steps, share))


def _unit(digits: int) -> str:
    return f"{'0.' + '0' * (digits - 1) + '1' if digits else '1'}BD"


def _sums(column: str, digits: int, kind: T.DataType) -> tuple[int, dict[str, str]]:
    """Digits behind the point of the unit, and the sums by name."""
    if isinstance(kind, T.DecimalType):
        precision, scale = kind.precision, kind.scale
    else:
        precision, scale = DIGITS[type(kind)], 0
    unit = max(scale, digits)
    narrow = precision + unit - scale <= 18
    if narrow:
        u = f"cast(cast({column} as decimal({precision},{scale})) * {10**unit}BD as bigint)"
        high, low = f"({u} div {PART})", f"({u} % {PART})"
        product = "decimal(18,0)"
    else:
        u = f"cast(cast({column} as decimal(38,{unit})) * {10**unit}BD as {WIDE})"
        high, low = _div(u, f"{PART}BD"), f"({u} % {PART}BD)"
        product = WIDE
    wide = {
        "n": f"count({column})",
        "high": f"sum(cast({high} as {product}))",
        "low": f"sum(cast({low} as {product}))",
        "hh": f"sum(cast({high} * {high} as {product}))",
        "hl": f"sum(cast({high} * {low} as {product}))",
        "ll": f"sum(cast({low} * {low} as {product}))",
    }
    return unit, {name: f"cast({sql} as {WIDE})" for name, sql in wide.items()}


def _div(num: str, den: str) -> str:
    """Quotient of whole decimals without its fraction; plain ``div`` gives 64 bits."""
    return f"cast((({num}) - ({num}) % ({den})) / ({den}) as {WIDE})"


def _floor(num: str, den: str) -> str:
    return f"cast((({num}) - pmod({num}, {den})) / ({den}) as {WIDE})"


def _wide(sql: str) -> str:
    return f"cast({sql} as {WIDE})"


def _squares() -> list[dict[str, str]]:
    """From the sums to four times the variance: ``q`` and the fraction ``e / nn``."""
    total = f"(s.high * {PART}BD + s.low)"
    # Sums of squares and products of the parts around those of m.
    hh = "(s.hh - 2 * s.mh * s.high + s.n * s.mh * s.mh)"
    hl = "(s.hl - s.mh * s.low - s.ml * s.high + s.n * s.mh * s.ml)"
    ll = "(s.ll - 2 * s.ml * s.low + s.n * s.ml * s.ml)"
    return [
        {"total": _wide(total), "m": _div(total, "s.n"), "d": _wide("nullif(s.n - 1, 0)")},
        {
            "r": _wide("s.total - s.m * s.n"),
            "mh": _div("s.m", f"{PART}BD"),
            "ml": _wide(f"s.m % {PART}BD"),
        },
        {"c": _wide(f"4 * ({hh} * {PART**2}BD + 2 * {hl} * {PART}BD + {ll})")},
        {
            "q": _div("s.c", "s.d"),
            "e": _wide("(s.c % s.d) * s.n - 4 * s.r * s.r"),
            "nn": _wide("s.n * s.d"),
        },
    ]


def _root(square: str, cut: int) -> list[dict[str, str]]:
    """The whole root of a whole number, its last ``cut`` digits left out."""
    x = _div(square, f"{10**cut}BD") if cut else _wide(square)
    return [
        {"x": x},
        {"near": _wide("floor(sqrt(cast(s.x as double)))")},
        # A step from within a few thousand of the root lands within one.
        {"step": f"case when s.near = 0 then s.near else {_div('s.near + ' + _div('s.x', 's.near'), '2')} end"},
        {
            "root": _wide(
                "case when (s.step + 1) * (s.step + 1) <= s.x then s.step + 1 "
                "when s.step * s.step <= s.x then s.step else s.step - 1 end"
            )
        },
    ]


def _chain(first: dict[str, str], steps: list[dict[str, str]], last: str) -> str:
    """``last`` over values named one after the other, each calculated once.

    A lambda over an array of one struct binds what the next steps name; what none of them
    names is left out.
    """
    held = list(first)
    sql = f"array(struct({', '.join(f'{e} as {n}' for n, e in first.items())}))"
    for i, step in enumerate(steps):
        later = " ".join([*(e for after in steps[i + 1 :] for e in after.values()), last])
        named = set(re.findall(r"\bs\.(\w+)", later))
        held = [name for name in held if name in named]
        kept = [f"s.{name} as {name}" for name in held]
        new = [f"{e} as {name}" for name, e in step.items()]
        sql = f"transform({sql}, s -> struct({', '.join(kept + new)}))"
        held += step
    return f"transform({sql}, s -> {last})[0]"

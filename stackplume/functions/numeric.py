"""Small numeric helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def column(value) -> Column:
    """Accept a Column, a column name or a plain number."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        return F.col(value)
    return F.lit(float(value))


def to_double(value) -> Column:
    """Text or number to double; unreadable values and NaN become NULL."""
    number = column(value).try_cast("double")
    return F.when(~F.isnan(number), number)


def clamp(value, low: float, high: float) -> Column:
    """Limit to [low, high] and keep NULL."""
    v = column(value)
    return F.when(v < low, F.lit(float(low))).when(v > high, F.lit(float(high))).otherwise(v)


def total(columns) -> Column:
    """Sum of column expressions, left to right."""
    return reduce(lambda left, right: left + right, columns)


def lookup(mapping: dict, key: Column, default=None) -> Column:
    """Value of ``key`` in a small fixed mapping, without a join."""
    pairs = [F.lit(item) for pair in mapping.items() for item in pair]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def ladder(value: Column, steps, last, strict: bool = False) -> Column:
    """First label whose upper bound holds ``value``; NULL stays NULL."""
    expression = F.when(value.isNull(), F.lit(None))
    for bound, label in steps:
        expression = expression.when(value < bound if strict else value <= bound, F.lit(label))
    return expression.otherwise(F.lit(last))


def printed(value, digits: int) -> Column:
    """The number with ``digits`` (1 to 3) decimals; a printed tie is decided by the exact binary value, then half-even.

    The fraction of a double is a whole number of 2**-52 from 1 on; below 1 what lies under that unit is carried along
    and breaks ties upwards.  Whole-number arithmetic then decides exactly.  NULL prints as "null".
    """
    v = column(value)
    unit, power = 1 << 52, 10**digits
    whole = F.floor(F.abs(v))
    exact = (F.abs(v) - whole) * F.lit(float(unit))
    units = F.floor(exact)
    under = (exact - units) * F.lit(float(power))
    scaled = units * F.lit(power) + F.floor(under)
    digit, rest = F.shiftright(scaled, 52), scaled.bitwiseAND(F.lit(unit - 1))
    above = (rest > unit // 2) | ((rest == unit // 2) & ((under > F.floor(under)) | (digit % 2 == 1)))
    total = whole * F.lit(power) + digit + above.cast("bigint")
    text = F.concat(
        F.when(v < 0, F.lit("-")).otherwise(F.lit("")), F.floor(total / power).cast("string"), F.lit("."),
        F.lpad((total % power).cast("string"), digits, "0"),
    )
    return F.when(F.abs(v) < 1e12, text).otherwise(F.format_string(f"%.{digits}f", v))

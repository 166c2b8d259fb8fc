"""Null rules.

Unknown values travel through a conditional instead of falling into its ``otherwise``, a strict
aggregate is unknown as soon as one input is, and division by zero is unknown rather than an error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def if_known(cond: Column, yes, no) -> Column:
    """``yes``/``no`` by condition; null when the condition itself is null."""
    return F.when(cond.isNull(), F.lit(None)).when(cond, yes).otherwise(no)


def replace_where(value: str | Column, cond: Column, new) -> Column:
    """``new`` where the condition is true; an unknown condition leaves the value alone."""
    value = col(value)
    return F.when(cond, new).otherwise(value)


def raise_to(value: str | Column, floor: float) -> Column:
    """Lift values below ``floor`` up to it; null stays null (``greatest`` would not keep it)."""
    value = col(value)
    return F.when(value < floor, F.lit(float(floor))).otherwise(value)


def na_zero(value: str | Column) -> Column:
    return F.coalesce(col(value), F.lit(0))


def flag(cond: Column) -> Column:
    """1/0 from a condition, null kept."""
    return cond.cast("int")


def flag_or_zero(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("int")


def ratio(num: Column, den: Column) -> Column:
    """Division that gives null for a zero denominator."""
    return F.try_divide(num, den)


def sum_strict(value: str | Column) -> Column:
    """Null as soon as one input is null; 0 for no input at all."""
    value = col(value)
    return F.when(F.count(F.lit(1)) == F.count(value), F.coalesce(F.sum(value), F.lit(0)))


def avg_strict(value: str | Column) -> Column:
    value = col(value)
    return F.when(F.count(F.lit(1)) == F.count(value), F.avg(value))


def sum_or_zero(value: str | Column) -> Column:
    """Nulls skipped; the sum of nothing is 0."""
    return F.coalesce(F.sum(col(value)), F.lit(0))


def all_true(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)

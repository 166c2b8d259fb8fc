"""Sums of doubles that do not depend on the order of addition.

A plain sum rounds after each addition, so its last digits follow from how rows are dealt out. Here every value is split
without error into whole numbers of a few fixed units, 24 bits apart; those are added as integers, which is exact in
any order, and put together at the end. All of it is built-in arithmetic, so partial sums combine on the map side.

Values count in whole 2**-72 (2e-22); parts below are cut off, value by value, so that also does not depend on the order.
Give the result another name than an input that later aggregates of the same list read, or put it last.
A total beyond 2**110 overflows and fails the job. Infinite values and NaN give what adding them gives.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import col, ratio

BITS = 24
LOWEST, HIGHEST = -72, 48
UNITS = tuple(2.0**e for e in range(LOWEST, HIGHEST + 1, BITS))

Window = Callable[[Column], Column]


def _plain(c: Column) -> Column:
    return c


def _parts(value: Column) -> list[Column]:
    """Whole numbers of each unit, lowest first. Remainders by powers of two are exact, and so is their difference."""
    rest = [value % F.lit(u) for u in UNITS[1:]] + [value]
    below = [value % F.lit(u) for u in UNITS]
    return [((r - b) / F.lit(u)).cast("long") for r, b, u in zip(rest, below, UNITS)]


def _carried(sums: Column) -> Column:
    """The sums (lowest unit first) as digits of 24 bits, the last one with all that is left and the sign."""
    start = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<long>").alias("digits"))

    def step(a: Column, s: Column) -> Column:
        full = a["carry"] + s
        return F.struct(F.shiftright(full, BITS).alias("carry"), F.concat(a["digits"], F.array(full - F.shiftleft(F.shiftright(full, BITS), BITS))).alias("digits"))

    return F.aggregate(sums, start, step, lambda a: F.concat(a["digits"], F.array(a["carry"])))


def _together(sums: Column) -> Column:
    """One double from the sums: digits of the absolute value, lowest first, so that each addition rounds little."""
    units = F.array(*[F.lit(u) for u in (*UNITS, 2.0 ** (HIGHEST + BITS))])
    sign = F.when(F.element_at(_carried(sums), -1) < 0, F.lit(-1)).otherwise(F.lit(1)).cast("long")
    turned = F.transform(sums, lambda s: s * sign)
    weighed = F.zip_with(_carried(turned), units, lambda d, u: d.cast("double") * u)
    return sign.cast("double") * F.aggregate(weighed, F.lit(0.0), lambda a, x: a + x)


def exact_sum(value: str | Column, over: Window = _plain) -> Column:
    """Sum with nulls skipped, null for nothing; the same bits however the rows lie. ``over`` makes it a window sum."""
    x = col(value).cast("double")
    odd = F.isnan(x) | (F.abs(x) == float("inf"))
    finite = F.when(~odd, x)
    sums = F.array(*[F.coalesce(over(F.sum(p)), F.lit(0).cast("long")) for p in _parts(finite)])
    return F.when(over(F.count(F.when(odd, x))) > 0, over(F.sum(F.when(odd, x)))).when(over(F.count(x)) > 0, _together(sums))


def exact_sum_strict(value: str | Column) -> Column:
    """Null as soon as one input is null; 0 for no input at all."""
    return F.when(F.count(F.lit(1)) == F.count(col(value)), exact_sum_or_zero(value))


def exact_sum_or_zero(value: str | Column) -> Column:
    return F.coalesce(exact_sum(value), F.lit(0.0))


def exact_avg(value: str | Column) -> Column:
    return ratio(exact_sum(value), F.count(col(value)).cast("double"))

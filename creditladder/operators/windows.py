"""Per-loan steps over months.

The window steps expect at most one row per (group, month); a group is then as long as the calendar,
not as the data. :func:`last_per` and :func:`monthly_sums` bring raw event rows into that form with
aggregates that combine on the map side, so a loan with very many events never lands in one task whole.
All steps of a frame that share ``by`` share one exchange.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.exact import exact_sum


def _names(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def ordered(by: str | Sequence[str], order: str | Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*_names(by)).orderBy(*[F.col(c).asc_nulls_last() for c in _names(order)])


def _so_far(by, order) -> WindowSpec:
    return ordered(by, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def last_per(df: DataFrame, by: str | Sequence[str], order: str | Sequence[str]) -> DataFrame:
    """The last row of each group. ``order`` should end in the input ordinal to settle ties; a null
    order value counts as last."""
    by, order = _names(by), _names(order)
    rest = [c for c in df.columns if c not in by]
    rank = F.struct(*[x for c in order for x in (F.col(c).isNull().alias(f"n_{c}"), F.col(c).alias(f"v_{c}"))])
    return (
        df.groupBy(*by)
        .agg(F.max_by(F.struct(*rest), rank).alias("__row"))
        .select(*by, *[F.col("__row")[c].alias(c) for c in rest])
    )


def monthly_sums(df: DataFrame, by: str | Sequence[str], sums: Mapping[str, str], exact: bool = False) -> DataFrame:
    """Sums per group with null counted as 0: ``sums`` maps output name -> input column."""
    add = exact_sum if exact else F.sum
    return df.groupBy(*_names(by)).agg(
        *[add(F.coalesce(F.col(c), F.lit(0.0))).alias(name) for name, c in sums.items()]
    )


def running_sum(
    df: DataFrame, sums: Mapping[str, str], by: str | Sequence[str], order: str | Sequence[str], exact: bool = False
) -> DataFrame:
    """Running totals; null adds nothing, and before the first known value the total is null. ``exact``: the same
    bits however rows of one order value lie."""
    w = _so_far(by, order)
    add = (lambda c: exact_sum(c, lambda s: s.over(w))) if exact else (lambda c: F.sum(c).over(w))
    return df.withColumns({name: add(c) for name, c in sums.items()})


def fill_down(df: DataFrame, cols: str | Sequence[str], by, order) -> DataFrame:
    """Null -> the last known value above it in the group."""
    w = _so_far(by, order)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in _names(cols)})


def fill_up(df: DataFrame, cols: str | Sequence[str], by, order) -> DataFrame:
    """Null -> the next known value below it in the group.

    Read in falling order this is a fill down; a frame that reaches to the end of the group would be
    recomputed for every row.
    """
    falling = Window.partitionBy(*_names(by)).orderBy(*[F.col(c).desc_nulls_first() for c in _names(order)])
    w = falling.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in _names(cols)})


def filled_down_then_up(c: str | Column, by, order) -> Column:
    """Both fills in one expression: what is above wins, and the gap at the top takes the group's first
    known value."""
    whole = ordered(by, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.coalesce(F.last(c, ignorenulls=True).over(_so_far(by, order)), F.first(c, ignorenulls=True).over(whole))


def cumulative_count(df: DataFrame, by: str | Sequence[str], order, name: str = "n_cum") -> DataFrame:
    """How many rows of the group up to here, all spells together (null is a group of its own)."""
    return df.withColumn(name, F.row_number().over(ordered(by, order)))


def run_length(df: DataFrame, by, order, value: str, name: str = "n_run") -> DataFrame:
    """Position in the unbroken spell of ``value``; each null is a spell of one row.

    One window spec throughout: the row number less that of the spell's first row, so no second sort
    by spell is needed.
    """
    w = ordered(by, order)
    change = F.coalesce(F.col(value) != F.lag(value).over(w), F.lit(True))
    return (
        df.withColumns({"__rn": F.row_number().over(w), "__change": change})
        .withColumn("__start", F.max(F.when(F.col("__change"), F.col("__rn"))).over(_so_far(by, order)))
        .withColumn(name, (F.col("__rn") - F.col("__start") + 1).cast("int"))
        .drop("__rn", "__change", "__start")
    )

"""Column selection by range, list or position, and wide -> long."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def columns_between(df: DataFrame, first: str, last: str) -> list[str]:
    i, j = df.columns.index(first), df.columns.index(last)
    return df.columns[min(i, j) : max(i, j) + 1]


def select_range(df: DataFrame, first: str, last: str, invert: bool = False) -> DataFrame:
    """The columns from ``first`` to ``last`` in frame order, or all the others."""
    inside = columns_between(df, first, last)
    return df.drop(*inside) if invert else df.select(*inside)


def select_existing(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns in frame order; names the frame does not have are ignored."""
    wanted = set(names)
    return df.select(*[c for c in df.columns if c in wanted])


def pick_positions(df: DataFrame, positions: Sequence[int], names: Sequence[str] | None = None) -> DataFrame:
    """Columns by 0-based position, renamed when ``names`` is given."""
    picked = df.select(*[F.col(f"`{df.columns[i]}`") for i in positions])
    return picked.toDF(*names) if names else picked


def gather_long(
    df: DataFrame, ids: Sequence[str], values: Sequence[str], key: str, value: str, labels: Mapping[str, str] | None = None
) -> DataFrame:
    """Wide -> long, nulls kept; ``labels`` renames the keys."""
    out = df.unpivot(list(ids), list(values), key, value)
    if not labels:
        return out
    named = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return out.withColumn(key, F.coalesce(named[F.col(key)], F.col(key)))


def unpivot_periods(df: DataFrame, ids: Sequence[str], stems: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Several columns per period -> one row per period, in one pass.

    ``stems`` maps period -> {output column: input column}.
    """
    rows = [
        F.struct(F.lit(period).alias("period"), *[F.col(src).alias(out) for out, src in cols.items()])
        for period, cols in stems.items()
    ]
    return df.select(*ids, F.inline(F.array(*rows)))

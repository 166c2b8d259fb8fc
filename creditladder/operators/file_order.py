"""Steps that depend on the row order of a file, given an ordinal column, without a one-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 500_000


def fill_down_ordered(df: DataFrame, col: str, ord: str = "_ord", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Null -> the last known value above it in file order, over the whole file.

    Ordinals are cut into chunks of ``chunk_rows``. Inside a chunk a window carries values down; what
    enters a chunk from above comes from a table with one row per chunk. ``ord`` must be unique and not
    null, so a chunk never exceeds ``chunk_rows`` rows; only the chunk table (rows / chunk_rows) is
    ordered in one task.
    """
    chunk = F.floor(F.col(ord) / F.lit(chunk_rows)).alias("__chunk")
    tail = df.groupBy(chunk).agg(
        F.max_by(F.when(F.col(col).isNotNull(), F.col(col)), F.when(F.col(col).isNotNull(), F.col(ord))).alias("__tail")
    )
    above = Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = tail.select("__chunk", F.last("__tail", ignorenulls=True).over(above).alias("__carry"))
    inside = Window.partitionBy("__chunk").orderBy(ord).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        df.withColumn("__chunk", F.floor(F.col(ord) / F.lit(chunk_rows)))
        .join(carry, "__chunk", "left")
        .withColumn(col, F.coalesce(F.last(col, ignorenulls=True).over(inside), F.col("__carry")))
        .select(*df.columns)
    )


def _edge(df: DataFrame, ord: str, n: int, last: bool) -> Column:
    """Ordinal of the n-th row from the top (or the end) as a scalar subquery."""
    key = F.col(ord).desc() if last else F.col(ord).asc()
    pick = F.min if last else F.max
    return df.select(ord).orderBy(key).limit(n).agg(pick(ord)).scalar()


def trim_rows(
    df: DataFrame, head: int = 2, tail: int = 1, ord: str = "_ord", ordinals: DataFrame | None = None
) -> DataFrame:
    """Without the first ``head`` and the last ``tail`` rows. ``ordinals`` may name an earlier frame with the
    same ordinals, so that finding the edges does not repeat the steps in between."""
    source = df if ordinals is None else ordinals
    out = df
    if head:
        out = out.filter(F.col(ord) > _edge(source, ord, head, last=False))
    if tail:
        out = out.filter(F.col(ord) < _edge(source, ord, tail, last=True))
    return out


def head_until_null(df: DataFrame, col: str, ord: str = "_ord") -> DataFrame:
    """Rows above the first null of ``col``; all rows when there is none."""
    first_null = df.filter(F.col(col).isNull()).agg(F.min(ord)).scalar()
    return df.filter(F.coalesce(F.col(ord) < first_null, F.lit(True)))


def drop_rollups(df: DataFrame, col: str, labels) -> DataFrame:
    """Without report roll-up rows (rows with an unknown label go too)."""
    return df.filter(~F.col(col).isin(*labels))

"""Aggregates. All of them combine on the map side, so a hot group costs no more than any other."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import exact_sum, exact_sum_or_zero, exact_sum_strict
from ..functions.nulls import avg_strict, ratio, sum_or_zero, sum_strict
from .joins import merge


def _names(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def sum_by(df: DataFrame, by, value: str, name: str, exact: bool = False) -> DataFrame:
    """Sum per key, unknown as soon as one input is. ``exact``: the same bits however the rows lie."""
    return df.groupBy(*_names(by)).agg((exact_sum_strict if exact else sum_strict)(value).alias(name))


def total_by(df: DataFrame, by, value: str, name: str, exact: bool = False) -> DataFrame:
    """Sum per key, nulls skipped. ``exact``: the same bits however the rows lie."""
    return df.groupBy(*_names(by)).agg((exact_sum_or_zero if exact else sum_or_zero)(value).alias(name))


def weighted_rate(weight: str, cond: Column) -> Column:
    """Share of the weight where the condition holds. Unknown conditions make it unknown."""
    hit = F.when(cond.isNull(), F.lit(None)).when(cond, F.col(weight)).otherwise(F.lit(0.0))
    return ratio(sum_strict(hit), sum_strict(weight))


def weighted_mean(value: str, weight: str, na: str = "pair", exact: bool = False) -> Column:
    """Weighted mean. ``na='each'``: numerator and denominator drop their own nulls;
    ``na='pair'``: the denominator counts only where the value is known, and a weight unknown there
    makes the mean unknown; ``na='strict'``: any null makes the mean unknown. ``exact``: sums that do not
    depend on how the rows lie."""
    v, w = F.col(value), F.col(weight)
    strict, known = (exact_sum_strict, exact_sum_or_zero) if exact else (sum_strict, sum_or_zero)
    if na == "each":
        return ratio(known(v * w), known(w))
    if na == "pair":
        complete = F.count_if(v.isNotNull() & w.isNull()) == 0
        return F.when(complete, ratio(known(v * w), known(F.when(v.isNotNull(), w))))
    if na == "strict":
        return ratio(strict(v * w), strict(w))
    raise ValueError("na must be 'each', 'pair' or 'strict'")


def means(df: DataFrame, cols: Sequence[str], strict: bool = False) -> DataFrame:
    """Mean of each column as rows (variable, mean)."""
    avg = avg_strict if strict else F.avg
    return df.agg(*[avg(c).alias(c) for c in cols]).unpivot([], list(cols), "variable", "mean")


def crosstab_long(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of value pairs, rows with a null on either side left out."""
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def value_counts(df: DataFrame, c: str, digits: int | None = None) -> DataFrame:
    """Counts per value without nulls; doubles are rounded first when ``digits`` is given."""
    key = F.col(c) if digits is None else F.round(c, digits)
    return df.select(key.alias(c)).filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))


def null_counts(df: DataFrame) -> DataFrame:
    cols = df.columns
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return counted.unpivot([], cols, "variable", "n_null")


def duplicate_keys(df: DataFrame, by) -> DataFrame:
    """One row: how many rows repeat a key seen before."""
    groups = df.groupBy(*_names(by)).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def month_total(df: DataFrame, time: str, value: str, name: str) -> DataFrame:
    """The month's total beside each row.

    A window over the month would put a whole month into one task; the totals are aggregated instead
    and joined back. Spark broadcasts them by their size.
    """
    totals = df.groupBy(time).agg(sum_strict(value).alias(name))
    return merge(df, totals, time, "left")


def category_share(df: DataFrame, time: str, category: str, balance: str) -> DataFrame:
    """Share of each category in the month's balance; a null balance makes its month unknown."""
    cats = df.groupBy(time, category).agg(
        sum_strict(balance).alias("cat_total"),
    )
    totals = cats.groupBy(time).agg(sum_strict("cat_total").alias("balance"))
    out = merge(cats, totals, time, "left")
    return out.withColumn("cat_prop", ratio(F.col("cat_total"), F.col("balance")))


CELLS = 1000


def calibration_bins(df: DataFrame, segments: Mapping[str, tuple[Column, Column]], label: Column, bins: int = 10, cells: int = CELLS) -> DataFrame:
    """Predicted beside actual rates by bins of the prediction, per segment: (segment, bin, n, n_unknown, low, high,
    mean_pd, mean_actual). ``segments`` maps segment -> (condition, probability); ``label`` is 1, 0 or null.

    One aggregation counts each segment's rows in ``cells`` equal steps of the probability, known and unknown labels
    apart. Such counts add up whatever the partitioning, and bins of about equal size are runs of cells: a cell belongs to the
    bin in which its first row falls. Bins are thus exact up to a cell's width and may be fewer where many predictions are
    alike. Rows without a prediction make up a bin of their own (null).
    """
    member = F.array_compact(
        F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(name).alias("segment"), p.cast("double").alias("p"))) for name, (cond, p) in segments.items()])
    )
    rows = df.select(F.explode(member).alias("m"), label.cast("double").alias("y")).select("m.segment", "m.p", "y")
    cell = F.when(F.col("p").isNotNull(), F.least(F.floor(F.col("p") * cells), F.lit(cells - 1)))
    counted = rows.groupBy("segment", cell.alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), F.count("y").alias("n_known"), F.min("p").alias("low"), F.max("p").alias("high"),
        exact_sum_or_zero("p").alias("p"), exact_sum_or_zero("y").alias("y"),
    )
    # At most one row per segment and cell.
    of = Window.partitionBy("segment", F.col("cell").isNull())
    above = F.coalesce(F.sum("n").over(of.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(of)
    dealt = counted.withColumn("bin", F.when(F.col("cell").isNotNull(), F.floor(above * bins / total).cast("int")))
    return dealt.groupBy("segment", "bin").agg(
        F.sum("n").alias("n"), (F.sum("n") - F.sum("n_known")).alias("n_unknown"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.when(F.col("bin").isNotNull(), ratio(exact_sum("p"), F.sum("n").cast("double"))).alias("mean_pd"),
        ratio(exact_sum("y"), F.sum("n_known").cast("double")).alias("mean_actual"),
    )


def calibration_table(df: DataFrame, segments: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """One row per (segment, statistic) from a single aggregation.

    ``segments`` maps segment -> {statistic: aggregate expression}.
    """
    cells = [(seg, stat, expr) for seg, stats in segments.items() for stat, expr in stats.items()]
    wide = df.agg(*[expr.cast("double").alias(f"c{i}") for i, (_, _, expr) in enumerate(cells)])
    rows = [
        F.struct(F.lit(seg).alias("segment"), F.lit(stat).alias("statistic"), F.col(f"c{i}").alias("value"))
        for i, (seg, stat, _) in enumerate(cells)
    ]
    return wide.select(F.inline(F.array(*rows)))

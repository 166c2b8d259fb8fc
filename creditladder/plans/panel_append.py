"""The next month of a stored panel from that month's rows and one row per loan, instead of from all history.

What a month's row needs of the months before it is little: running totals, the last known maturity and rating, the
present spell and how often each category was seen. These make up a loan's state. A new month is computed from its
own rows and the state, and gives the state after it.

One thing reaches back: a loan's first known rating also fills the months before it. Such ratings come out in a table of their own,
one row per loan and at most once for each column, which :func:`with_first_ratings` lays over the stored rows.
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import features as feat
from ..operators.joins import merge
from ..session import cut_lineage
from .panel import LOAN, MONTH, MONTH_NUMBER, OUTPUT, PanelSources, _months_single_pass, above_floor, add_features, loan_table, month_of

MONTHLY = ("balances", "ratings", "payments", "maturities", "categories")
RATINGS = ("risk_category_sf", "monitor_score")
CARRIED = ("paid_cum", "disb_cum", "maturity_date", *RATINGS)


@dataclass(frozen=True)
class Appended:
    """``panel``: the month's rows; ``state``: one row per loan after it; ``first_ratings`` (loan_id, risk_category_sf,
    monitor_score): what earlier months of a loan lacked and now get."""

    panel: DataFrame
    state: DataFrame
    first_ratings: DataFrame


def loan_state(months: DataFrame) -> DataFrame:
    """One row per loan from the loan-months so far (:func:`panel.months_table`): its carried values, its last category
    and the length of that spell, and the months seen per category. Two exchanges of narrow rows, both combining on
    the map side. A month that cannot be read has no place in an order by month and fails the job."""
    readable = F.assert_true(F.col(MONTH).isNotNull(), F.lit("a loan-month without a date")).isNull()
    rows = months.filter(readable)
    last = F.max_by(F.struct(*CARRIED, F.col("risk_category").alias("last_category"), F.col("months_in_risk_cat").alias("spell")), MONTH)
    seen = rows.groupBy(LOAN, "risk_category").agg(F.count(F.lit(1)).cast("int").alias("n"), last.alias("row"), F.max(MONTH).alias(MONTH))
    # A loan has as many rows here as the ladder has rungs.
    one = seen.groupBy(LOAN).agg(
        F.max_by("row", MONTH).alias("row"), F.max(MONTH).alias("last_month"),
        F.map_from_entries(F.collect_list(F.struct(_rung("risk_category"), "n"))).alias("seen"),
    )
    return one.select(LOAN, "last_month", "row.*", "seen")


def _rung(c: str) -> Column:
    """A map's key for a category, unknown ones included."""
    return F.coalesce(F.col(c), F.lit(-1)).alias("rung")


def of_month(src: PanelSources, date: str) -> PanelSources:
    """The sources with the rows of one month (any day of it) in the monthly tables."""
    first, last = (f(F.lit(date).cast("date")) for f in (lambda d: F.trunc(d, "MM"), F.last_day))
    return dataclasses.replace(src, **{name: getattr(src, name).filter(F.col(MONTH).between(first, last)) for name in MONTHLY})


def append_month(src: PanelSources, state: DataFrame, date: str, loans: DataFrame | None = None, durable: bool = False) -> Appended:
    """The panel's rows of the month of ``date`` from the sources' rows of that month and the ``state`` before it.

    Equals the month's rows of a full build (with unique source keys) on all months up to it. A state that is not
    older than the month fails the job. Loans without a row this month keep their state. ``loans`` is
    :func:`loan_table` where it is stored already. With ``durable`` the month's rows are written to the shared folder once, and the
    panel, the state and the first ratings read them there instead of computing them each.
    """
    months = _months_single_pass(of_month(src, date)).withColumnsRenamed({"paid_cum": "paid_now", "disb_cum": "disb_now"})
    months = months.withColumn(MONTH, month_of(MONTH_NUMBER)).drop(MONTH_NUMBER)
    older = F.assert_true(F.col("last_month").isNull() | (F.col("last_month") < F.col(MONTH)), F.lit("the state is not older than the month")).isNull()
    before = state.withColumnsRenamed({c: f"__{c}" for c in CARRIED})
    joined = merge(months, before, LOAN, "left", null_keys="drop").filter(older)

    sums = {total: F.coalesce(F.col(f"__{total}") + F.col(now), F.col(f"__{total}"), F.col(now)) for total, now in (("paid_cum", "paid_now"), ("disb_cum", "disb_now"))}
    filled = {c: F.coalesce(F.col(c), F.col(f"__{c}")) for c in ("maturity_date", *RATINGS)}
    counts = {
        "months_in_risk_cat": F.when(F.col("risk_category") == F.col("last_category"), F.col("spell") + 1).otherwise(1).cast("int"),
        "months_in_risk_cat_cum": (F.coalesce(F.try_element_at("seen", _rung("risk_category")), F.lit(0)) + 1).cast("int"),
    }
    rows = joined.withColumns({**{f"__had_{c}": F.col(f"__{c}").isNotNull() for c in RATINGS}, **sums, **filled, **counts})

    rows = cut_lineage(rows, "month") if durable else rows

    panel = merge(rows.filter(above_floor()), loan_table(src) if loans is None else loans, LOAN, "left", null_keys="drop")
    first = rows.filter(F.col("last_month").isNotNull()).select(LOAN, *[F.when(~F.col(f"__had_{c}"), F.col(c)).alias(c) for c in RATINGS])
    return Appended(add_features(panel).select(*OUTPUT), _after(state, rows), first.filter(" or ".join(f"{c} is not null" for c in RATINGS)))


def _after(state: DataFrame, rows: DataFrame) -> DataFrame:
    seen = F.coalesce("seen", F.expr("cast(map() as map<int, int>)"))
    others = F.map_filter(seen, lambda k, _: k != _rung("risk_category"))
    now = rows.select(
        LOAN, F.col(MONTH).alias("last_month"), *CARRIED, F.col("risk_category").alias("last_category"), F.col("months_in_risk_cat").alias("spell"),
        F.map_concat(others, F.create_map(_rung("risk_category"), "months_in_risk_cat_cum")).alias("seen"),
    )
    kept = state.join(now.select(LOAN), LOAN, "left_anti")
    return now.unionByName(kept)


def with_first_ratings(panel: DataFrame, first_ratings: DataFrame) -> DataFrame:
    """The stored rows of earlier months with ratings that became known later. A loan has at most one such rating per
    column; on a panel stored by loan its rows stay where they are."""
    given = first_ratings.groupBy(LOAN).agg(*[F.max(c).alias(f"__{c}") for c in RATINGS])
    joined = merge(panel, given, LOAN, "left", null_keys="drop")
    late = F.col("__monitor_score").isNotNull()
    return joined.withColumns(
        {
            "risk_category_sf": F.coalesce("risk_category_sf", "__risk_category_sf"),
            # All earlier months of such a loan had no score.
            "watch_list": F.when(late, feat.on_watch_list("__monitor_score")).otherwise(F.col("watch_list")),
        }
    ).select(*panel.columns)

"""The loan-month panel (month ends) and the loan features on it.

Shape of the plan with unique source keys (``duplicates='error'``):

1. balances, payments, maturities and monthly categories are laid on one narrow schema and reduced by a
   single aggregation on (loan, month). It combines on the map side, so a loan or month that holds a
   large part of the raw rows is shrunk before it travels; what outer joins would do with three more
   shuffles is a matter of which source was seen.
2. monitoring ratings are reduced to the month's last row and joined on the same partitioning.
3. one exchange by loan (at most one row per month by now) carries every window step.
4. the balance filter comes before the loan-level join, whose four sources are reduced to one table.

``duplicates='repeat'`` is the join-by-join form, in which repeated keys repeat rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import features as feat
from ..functions.dates import month_end
from ..functions.ladder import reached_flags
from ..functions.nulls import col, flag_or_zero
from ..operators.joins import guard_single, merge
from ..operators.windows import (
    cumulative_count,
    fill_down,
    filled_down_then_up,
    last_per,
    monthly_sums,
    run_length,
    running_sum,
)

KEY = ["loan_id", "date"]
LOAN, MONTH = KEY
# Inside the single pass a month is a number, and an unreadable one is the number no month has: it sorts last like
# the null it stands for, and plain key equality lets the steps share one partitioning.
MONTH_NUMBER = "__month"
NO_MONTH = 2**31 - 1
# In the join-by-join form a missing loan id is an id like any other.
LOAN_KEY = ["__no_loan", "__loan"]

OUTPUT = [
    "loan_id", "date", "balance", "risk_category_sf", "paid_cum", "disb_cum", "maturity_date", "risk_category",
    "collateral", "guarantee", "recovery", "pd_one_year", "close_date", "maturity_at_origination", "active", "wo",
    "months_in_risk_cat_cum", "months_in_risk_cat_cum_sq", "months_in_risk_cat", "months_in_risk_cat_sq",
    "months_in_risk_cat_cube", "remaining_tenor", "watch_list", "pmt_1k", "pd",
    "current", "special_mention", "substandard", "doubtful",
]


@dataclass(frozen=True)
class PanelSources:
    """Typed inputs, as the loaders give them.

    balances (loan_id, date, balance); ratings (loan_id, date, monitor_score, risk_category_sf, _ord);
    payments (loan_id, date, paid, disbursed); maturities (loan_id, date, maturity_date,
    outstanding_principal); categories (loan_id, date, risk_category); collateral (loan_id,
    collateral_type); guarantees (loan_id, guarantee); recoveries (loan_id, recovery); pds (loan_id,
    pd_one_year, close_date, maturity_at_origination, active, wo).
    """

    balances: DataFrame
    ratings: DataFrame
    payments: DataFrame
    maturities: DataFrame
    categories: DataFrame
    collateral: DataFrame
    guarantees: DataFrame
    recoveries: DataFrame
    pds: DataFrame


LOAN_COLUMNS = {
    "collateral": ["collateral_type"],
    "guarantees": ["guarantee"],
    "recoveries": ["recovery"],
    "pds": ["pd_one_year", "close_date", "maturity_at_origination", "active", "wo"],
}


def month_number(c: str | Column) -> Column:
    """Months since year 0, or ``NO_MONTH``."""
    return F.coalesce(F.year(c) * 12 + F.month(c) - 1, F.lit(NO_MONTH))


def month_of(number: str | Column) -> Column:
    """The month's last day; null for ``NO_MONTH``."""
    n = F.nullif(col(number), F.lit(NO_MONTH))
    return F.last_day(F.make_date(F.floor(n / 12).cast("int"), n % 12 + 1, F.lit(1)))


def one_per_month(ratings: DataFrame) -> DataFrame:
    """Each loan-month's last rating; ties go to the later row of the file."""
    return _last_rating(ratings.withColumn(MONTH_NUMBER, month_end(MONTH))).withColumnRenamed(MONTH_NUMBER, MONTH)


def _last_rating(ratings: DataFrame) -> DataFrame:
    kept = last_per(ratings, [LOAN, MONTH_NUMBER], ["date", "_ord"])
    return kept.select(LOAN, MONTH_NUMBER, "monitor_score", "risk_category_sf")


def _combine(parts: Mapping[str, DataFrame], by: list[str], sums: set[str] = frozenset()) -> DataFrame:
    """Lay sources with distinct columns side by side with one aggregation: per key the single row of each
    source (guarded) or, for columns in ``sums``, their total. ``has_<source>`` tells which were seen."""
    tall = None
    for name, part in parts.items():
        part = part.withColumn(f"__n_{name}", F.lit(1))
        tall = part if tall is None else tall.unionByName(part, allowMissingColumns=True)
    values = [c for c in tall.columns if c not in by and not c.startswith("__n_")]
    aggs = [(F.sum(c) if c in sums else F.max(c)).alias(c) for c in values]
    seen = [F.count(f"__n_{n}").alias(f"__n_{n}") for n in parts]
    out = tall.groupBy(*by).agg(*aggs, *seen)
    for name, part in parts.items():
        if not set(part.columns) & sums:
            key = ", ".join(MONTH if c == MONTH_NUMBER else c for c in by)
            out = out.filter(guard_single(f"__n_{name}", f"{name}: repeated key {key}"))
    return out.select(*by, *values, *[(F.col(f"__n_{n}") > 0).alias(f"has_{n}") for n in parts])


def _months_single_pass(src: PanelSources) -> DataFrame:
    # A row without a loan id never meets a balance above the floor: those rows go first.
    def keyed(df: DataFrame, *values) -> DataFrame:
        return df.filter(F.col(LOAN).isNotNull()).select(LOAN, month_number(MONTH).alias(MONTH_NUMBER), *values)

    months = _combine(
        {
            "balances": keyed(src.balances, "balance"),
            "payments": keyed(src.payments, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("paid", "disbursed")]),
            "maturities": keyed(src.maturities, "maturity_date", "outstanding_principal"),
            "categories": keyed(src.categories, "risk_category"),
        },
        [LOAN, MONTH_NUMBER],
        sums={"paid", "disbursed"},
    )
    months = months.filter("has_balances or has_payments or has_maturities")
    ratings = _last_rating(keyed(src.ratings, "date", "_ord", "monitor_score", "risk_category_sf"))
    rated = merge(months, ratings, [LOAN, MONTH_NUMBER], "left", null_keys="drop")
    rated = rated.withColumns(
        {c: F.when(F.col("has_balances"), F.col(c)) for c in ("monitor_score", "risk_category_sf")}
    )
    return running_sum(rated, {"paid_cum": "paid", "disb_cum": "disbursed"}, LOAN, MONTH_NUMBER)


def _months_by_joins(src: PanelSources) -> DataFrame:
    paid = monthly_sums(
        src.payments.withColumn(MONTH, month_end(MONTH)), KEY, {"paid_month": "paid", "disbursed_month": "disbursed"}
    )
    paid = running_sum(paid, {"paid_cum": "paid_month", "disb_cum": "disbursed_month"}, LOAN, MONTH)
    df = merge(src.balances, one_per_month(src.ratings), KEY, "left")
    # A full join's rows travel again to the next join, so the source with the most months comes last.
    df = merge(df, src.maturities, KEY, "full")
    df = merge(df, paid.select(*KEY, "paid_cum", "disb_cum"), KEY, "full")
    df = _loan_keyed(merge(df, src.categories, KEY, "left"))
    for name, cols in LOAN_COLUMNS.items():
        part = _loan_keyed(getattr(src, name).select(LOAN, *cols)).drop(LOAN)
        df = merge(df, part, LOAN_KEY, "left", null_keys="drop")
    return df


def _loan_keyed(df: DataFrame) -> DataFrame:
    """Adds ``LOAN_KEY``, which is never null: joins by it match missing loan ids with plain equality, and the windows
    by it that follow find the rows where the joins left them."""
    missing = F.lit("0").cast(df.schema[LOAN].dataType)
    return df.withColumns(dict(zip(LOAN_KEY, (F.col(LOAN).isNull(), F.coalesce(LOAN, missing)))))


def _along_months(df: DataFrame, carry: list[str], month: str, loan: str | list[str] = LOAN) -> DataFrame:
    """Fills and month counts. Steps with the same window spec stand together and the one with the finer
    partition comes last: one exchange, two sorts."""
    df = fill_down(df, carry, loan, month)
    df = df.withColumns({c: filled_down_then_up(c, loan, month) for c in ("risk_category_sf", "monitor_score")})
    df = run_length(df, loan, month, "risk_category", "months_in_risk_cat")
    by = [loan] if isinstance(loan, str) else loan
    return cumulative_count(df, [*by, "risk_category"], month, "months_in_risk_cat_cum")


def loan_table(src: PanelSources) -> DataFrame:
    """The loan-level sources as one row per loan."""
    parts = {name: getattr(src, name).select(LOAN, *cols) for name, cols in LOAN_COLUMNS.items()}
    combined = _combine(parts, [LOAN])
    return combined.drop(*[f"has_{n}" for n in parts])


def months_table(src: PanelSources, duplicates: str = "error") -> DataFrame:
    """All loan-months, below the balance floor too, with fills and month counts."""
    if duplicates == "error":
        df = _along_months(_months_single_pass(src), ["maturity_date"], MONTH_NUMBER)
        return df.withColumn(MONTH, month_of(MONTH_NUMBER)).drop(MONTH_NUMBER)
    if duplicates == "repeat":
        return _along_months(_months_by_joins(src), ["maturity_date", "paid_cum", "disb_cum"], MONTH, LOAN_KEY).drop(*LOAN_KEY)
    raise ValueError("duplicates must be 'error' or 'repeat'")


def above_floor() -> Column:
    return F.col("balance") > feat.PANEL_BALANCE_FLOOR


def build_panel(
    src: PanelSources, duplicates: str = "error", observe: Callable[[DataFrame], DataFrame] | None = None,
    months: DataFrame | None = None, loans: DataFrame | None = None,
) -> DataFrame:
    """The panel with all features, balances above the floor only. ``observe`` may put metrics on the months
    before the floor. ``months`` (:func:`months_table`) and ``loans`` (:func:`loan_table`) of the same sources are
    taken where they are stored already."""
    df = months_table(src, duplicates) if months is None else months
    df = (observe(df) if observe else df).filter(above_floor())
    if duplicates == "error":
        df = merge(df, loan_table(src) if loans is None else loans, LOAN, "left", null_keys="drop")
    return add_features(df).select(*OUTPUT)


def add_features(df: DataFrame) -> DataFrame:
    df = df.withColumns(
        {
            "remaining_tenor": feat.remaining_tenor("maturity_date", "maturity_at_origination", MONTH),
            "watch_list": feat.on_watch_list("monitor_score"),
            "pmt_1k": feat.has_paid("paid_cum"),
            "collateral": feat.hard_collateral("collateral_type"),
            **month_powers(),
        }
    )
    return df.withColumns(
        {
            "pd": feat.cumulative_pd("pd_one_year", "remaining_tenor"),
            **reached_flags("risk_category", "wo"),
        }
    )


def month_powers() -> dict[str, Column]:
    """Square and cube terms of the month counts."""
    run, cum = F.col("months_in_risk_cat"), F.col("months_in_risk_cat_cum")
    return {
        "months_in_risk_cat_sq": F.pow(run, F.lit(2)),
        "months_in_risk_cat_cube": F.pow(run, F.lit(3)),
        "months_in_risk_cat_cum_sq": F.pow(cum, F.lit(2)),
    }


def active_as_of(panel: DataFrame, date: str) -> DataFrame:
    """Sets ``active``: 1 when the loan has a positive balance on that day, else 0.

    A window by loan: right behind :func:`build_panel` it needs no exchange of its own, and the panel is
    read once.
    """
    return panel.withColumn("active", F.max(flag_or_zero(_alive(date))).over(Window.partitionBy(LOAN)))


def active_as_of_stored(panel: DataFrame, date: str) -> DataFrame:
    """The same on a stored panel: the loans come from the scan of that one month and are joined by loan, so where the panel
    is stored by loan none of its rows travel. Loans without an id are not active."""
    alive = panel.filter(_alive(date)).select(F.col(LOAN).alias("__alive")).distinct()
    joined = panel.join(alive, F.col(LOAN) == F.col("__alive"), "left")
    return joined.withColumn("active", F.col("__alive").isNotNull().cast("int")).select(*panel.columns, *(["active"] if "active" not in panel.columns else []))


def _alive(date: str) -> Column:
    return (F.col("balance") > 0) & (F.col(MONTH) == F.lit(date).cast("date"))

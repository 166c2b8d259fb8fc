"""Migration chain: category -> next category, each stage fed by the prediction of the one before."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ladder import FLAGS, pit_flags
from ..functions.exact import exact_sum_or_zero, exact_sum_strict
from ..functions.nulls import all_true
from ..functions.probability import (
    MIGRATIONS,
    active_pd,
    active_pd_from_flags,
    by_category,
    chain_products,
    next_downgrade,
)
from ..operators.aggregates import weighted_mean
from ..operators.joins import merge
from ..operators.reshape import gather_long, unpivot_periods
from .models import FittedLogit, Segment, fit_linear, fit_logits
from .segments import wo_label

# Label of each stage and the rungs a loan must have reached to be in it.
STAGES = (
    ("pm_sm", "special_mention", "pd", ()),
    ("pm_substandard", "substandard", "pm_sm", ("special_mention",)),
    ("pm_doubtful", "doubtful", "pm_substandard", ("special_mention", "substandard")),
    ("pm_wo", "wo", "pm_doubtful", ("special_mention", "substandard", "doubtful")),
)


def fit_chain(df: DataFrame) -> dict[str, FittedLogit]:
    """Four nested fits on closed loans. ``df``: active, pd, reached flags, wo.

    The narrow training frame is kept for all stages; a stage's input probability is an expression on it.
    """
    base = df.filter(F.col("active") == 0).select("pd", *FLAGS[1:], wo_label().alias("wo"))
    base = base.persist(StorageLevel.MEMORY_AND_DISK)
    chain: dict[str, FittedLogit] = {}
    try:
        for name, label, feature, reached in STAGES:
            where = all_true([F.col(r) == 1 for r in reached]) if reached else None
            segment = Segment(F.col(label), (feature,), where, label)
            chain.update(fit_logits(chain_scores(base, chain), {name: segment}, persist=False))
    finally:
        base.unpersist()
    return chain


def chain_scores(df: DataFrame, chain: Mapping[str, FittedLogit]) -> DataFrame:
    """Adds the migration probabilities in ladder order, each computed from the one before."""
    for name, *_ in STAGES:
        if name in chain:
            df = df.withColumn(name, chain[name].probability())
    return df


def add_chain_products(df: DataFrame) -> DataFrame:
    return df.withColumns(chain_products())


def historic_means(df: DataFrame, category: str = "risk_category") -> Column:
    """Mean migration probability of the loans that stand on each of the last three rungs: one aggregated
    row as a scalar struct (to_sub, to_doubtful, to_wo)."""
    rungs = (
        ("to_sub", "pm_substandard", "Special Mention"),
        ("to_doubtful", "pm_doubtful", "Substandard"),
        ("to_wo", "pm_wo", "Doubtful"),
    )
    means = [F.avg(F.when(F.col(category) == label, F.col(pm))).alias(name) for name, pm, label in rungs]
    return df.agg(F.struct(*means).alias("means")).scalar()


def active_pd_avg(df: DataFrame, category: str = "risk_category", history: DataFrame | None = None) -> Column:
    """Own probability of the next step times the historic mean rates of the later steps."""
    means = historic_means(df if history is None else history, category)
    to_sub, to_doubtful, to_wo = (means[name] for name in ("to_sub", "to_doubtful", "to_wo"))
    return by_category(
        category,
        [
            F.col("pm_sm") * (to_sub * to_doubtful * to_wo),
            F.col("pm_substandard") * (to_doubtful * to_wo),
            F.col("pm_doubtful") * to_wo,
            F.col("pm_wo"),
        ],
    )


def rate_active_book(book: DataFrame, chain: Mapping[str, FittedLogit], compat: bool = False) -> DataFrame:
    """Active loans with their migration probabilities, active PD, the variant on historic means, the
    probability of the next downgrade and the category-free expected loss. ``book``: loan_id, pd, active,
    risk_category, balance."""
    scored = chain_scores(book, chain)
    active = scored.filter(F.col("active") == 1)
    return active.withColumns(
        {
            "pd_active": active_pd("risk_category"),
            "pd_active_avg_downgrade": active_pd_avg(active, history=scored),
            "migration_to_next_cat_prob": next_downgrade("risk_category", compat=compat),
        }
    ).withColumn("el", F.col("pd_active") * F.col("balance"))


def book_loss(book: DataFrame, category: str = "risk_category") -> DataFrame:
    """Expected loss of the active book without its categories' own losses, per slice (Current, below it, unrated, and
    all): the number of loans, their balance (unknown as soon as one is), the loss, its rate over the balance (of all
    loans, and of those with a known probability), and plain means of the probabilities. ``book``: active, pd, pd_active,
    balance. Each loan counts in its own slice and in the whole, both from one aggregation."""
    current = F.col(category) == "Current"
    own = F.when(current, "Current").when(~current, "below").otherwise("unrated")
    return (
        book.filter(F.col("active") == 1)
        .withColumn("slice", F.explode(F.array(own, F.lit("all"))))
        .groupBy("slice")
        .agg(
            F.count(F.lit(1)).alias("n_loans"),
            exact_sum_or_zero(F.col("pd_active") * F.col("balance")).alias("el"),
            weighted_mean("pd_active", "balance", "each", exact=True).alias("loss_rate"),
            weighted_mean("pd_active", "balance", "pair", exact=True).alias("loss_rate_known"),
            F.avg("pd_active").alias("mean_pd_active"),
            F.avg("pd").alias("mean_pd"),
            # Last, as the name would hide the input column from what follows.
            exact_sum_strict("balance").alias("balance"),
        )
    )


def chain_report(scored: DataFrame) -> DataFrame:
    """(variable, mean, n_null) of the chain's probabilities and their products over all scored loans."""
    names = [*MIGRATIONS, *chain_products()]
    df = add_chain_products(scored)
    wide = df.agg(*[F.avg(c).alias(c) for c in names], *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in names])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("mean"), F.col(f"n_{c}").alias("n_null")) for c in names])))


LONG_COLUMNS = ("pd", "pd_sm", "pd_substandard", "pd_doubtful", "pdx")


def chain_long(scored: DataFrame, key: str = "loan_id") -> DataFrame:
    """(loan, migration, pds): the original probability and the chain's products, one row each."""
    return gather_long(scored, [key], list(LONG_COLUMNS), "migration", "pds")


def chain_line(scored: DataFrame) -> DataFrame:
    """One row (intercept, slope): the straight line of the chain's product on the original probability."""
    return fit_linear(scored, "pdx", "pd")


def period_table(
    loans: DataFrame, categories: DataFrame, balances: DataFrame, periods: Mapping[str, tuple[str, str]]
) -> DataFrame:
    """One row per loan and period with the flags of that date. ``periods`` maps period -> (category
    column, balance column)."""
    wide = merge(merge(loans, categories, "loan_id", "left"), balances, "loan_id", "left")
    stems = {p: {"category_code": cat, "balance": bal} for p, (cat, bal) in periods.items()}
    long = unpivot_periods(wide, loans.columns, stems)
    return long.withColumns(pit_flags("category_code", "balance"))


def point_in_time(periods: DataFrame, chain: Mapping[str, FittedLogit]) -> DataFrame:
    """Active PD of every loan active at each period, all periods in one pass."""
    active = chain_scores(periods.filter(F.col("active") == 1), chain)
    return active.withColumn("pd_active", active_pd_from_flags(FLAGS))


def period_means(pit: DataFrame, by: Sequence[str] = ("period",)) -> DataFrame:
    """Balance-weighted and plain means of both probabilities per period."""
    return pit.groupBy(*by).agg(
        weighted_mean("pd", "balance", "each").alias("weighted_pd"),
        weighted_mean("pd_active", "balance", "each").alias("weighted_pd_active"),
        F.avg("pd").alias("mean_pd"),
        F.avg("pd_active").alias("mean_pd_active"),
    )


"""Loan features as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import years_between
from .nulls import col, flag_or_zero, raise_to

# Fixed values of the portfolio's rules.
HARD_COLLATERAL = ("Real Estate", "Equipment and Machinery")
WATCH_LIST_SCORES = (60, 70)
PAID_THRESHOLD = 1000
PANEL_BALANCE_FLOOR = 200
EXPOSURE_BALANCE_FLOOR = 500
LOSS_GIVEN_DEFAULT = 0.90


def remaining_tenor(maturity, maturity_at_origination, date) -> Column:
    """Years to maturity (to the original maturity when no later one is known), one at least."""
    return raise_to(years_between(F.coalesce(col(maturity), col(maturity_at_origination)), date), 1)


def on_watch_list(score) -> Column:
    low, high = WATCH_LIST_SCORES
    return flag_or_zero((col(score) >= low) & (col(score) < high))


def has_paid(paid_cum) -> Column:
    return flag_or_zero(col(paid_cum) >= PAID_THRESHOLD)


def cumulative_pd(pd_one_year, tenor) -> Column:
    """One-year default probability carried over the tenor."""
    return 1 - F.pow(1 - col(pd_one_year), col(tenor))


def hard_collateral(collateral_type) -> Column:
    """True when the text names hard collateral; unknown text is false."""
    c = col(collateral_type)
    hit = F.lit(False)
    for words in HARD_COLLATERAL:
        hit = hit | c.contains(words)
    return F.coalesce(hit, F.lit(False))

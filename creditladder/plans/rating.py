"""Write-off probability from the risk rating: a factor model and a straight line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import value_counts
from ..operators.reshape import select_existing
from .models import fit_linear, fit_rating_factor, score_linear, score_rating_factor

BOOK_COLUMNS = (
    "pd_rr", "balance_0915", "sector", "loan_id", "last_year", "loan_type", "amount", "september_risk_category",
)


def closed_last_year() -> Column:
    return (F.col("active") == 0) & (F.col("last_year") == 1)


def active_last_year() -> Column:
    return (F.col("active") == 1) & (F.col("balance_0915") > 0) & (F.col("last_year") == 1)


def rate_by_factor(loans: DataFrame) -> DataFrame:
    """All loans with ``pd_rr``; the fit uses closed loans of the last year."""
    return score_rating_factor(loans, fit_rating_factor(loans, "risk_rating", "writeoff", closed_last_year()), "risk_rating")


def rate_by_line(loans: DataFrame) -> DataFrame:
    """All loans with ``pd_rr_lm``."""
    line = fit_linear(loans, "writeoff", "risk_rating", closed_last_year())
    return score_linear(loans, line, "risk_rating", "pd_rr_lm")


def rated_book(rated: DataFrame) -> DataFrame:
    """The active book for a later loss study."""
    return select_existing(rated.filter(active_last_year()), BOOK_COLUMNS)


def predicted_counts(rated: DataFrame, column: str) -> DataFrame:
    """How many loans got each predicted value (10 digits)."""
    return value_counts(rated, column, 10)

"""Monthly exposure (month starts), expected loss and the portfolio's loss rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.features import EXPOSURE_BALANCE_FLOOR, LOSS_GIVEN_DEFAULT
from ..functions.nulls import if_known, na_zero, ratio, replace_where, sum_or_zero
from ..operators.aggregates import category_share
from ..operators.joins import merge, unique_by
from ..operators.reshape import select_range

PROFILE = ["loan_id", "rc_opp_number", "pd", "pd_sm_wo", "pd_sub_wo", "pd_d_wo", "wo"]


def build_exposure(
    balances: DataFrame, profile: DataFrame, guarantees: DataFrame, ratings: DataFrame, null_keys: str = "match",
    duplicates: str = "error",
) -> DataFrame:
    """Balances with each loan's probabilities, guarantee and the month's category.

    balances (loan_id, time, balance), profile (see PROFILE), guarantees (loan_id, guarantee, notes),
    ratings (rc_opp_number, time, risk_category). Loans without a profile have no opportunity number;
    ``null_keys`` decides whether they meet ratings without one. Balance rows without a readable id may
    be many, so the full join is the one that spreads them.

    ``duplicates="error"``: a repeated loan of the profile or the guarantees, or a repeated (number, month) of
    the ratings, blank and missing numbers included, fails the job. With ``"repeat"`` repeated keys repeat
    rows, so many ratings without a number multiply with the loans without one.
    """
    if duplicates not in ("error", "repeat"):
        raise ValueError("duplicates must be 'error' or 'repeat'")
    if duplicates == "error":
        profile, guarantees = unique_by(profile.select(*PROFILE), "loan_id", "profile"), unique_by(guarantees, "loan_id", "guarantees")
        ratings = unique_by(ratings, ["rc_opp_number", "time"], "ratings")
    rap = merge(profile.select(*PROFILE), guarantees, "loan_id", "left", null_keys)
    pro = merge(balances, rap, "loan_id", "full", null_keys, hot_keys=True)
    return merge(pro, ratings, ["rc_opp_number", "time"], "left", null_keys)


def clean_exposure(pro: DataFrame) -> DataFrame:
    """No guarantee known: none. A balance of 0 or more without a category: Current. Then balances below
    the floor count as 0 (so a negative balance keeps its unknown category)."""
    unrated = (F.col("balance") >= 0) & F.col("risk_category").isNull()
    return pro.select(
        *[
            {
                "guarantee": na_zero("guarantee"),
                "risk_category": replace_where("risk_category", unrated, F.lit("Current")),
                "balance": replace_where("balance", F.col("balance") < EXPOSURE_BALANCE_FLOOR, F.lit(0.0)),
            }.get(c, F.col(c)).alias(c)
            for c in pro.columns
        ]
    )


def pd_profile(category: str = "risk_category") -> Column:
    """The default probability that goes with the month's category; unknown category, unknown value."""
    out = F.col("pd")
    for label, column in (("Special Mention", "pd_sm_wo"), ("Substandard", "pd_sub_wo"), ("Doubtful", "pd_d_wo")):
        out = if_known(F.col(category) == label, F.col(column), out)
    return out


def expected_loss(pro: DataFrame, lgd: float = LOSS_GIVEN_DEFAULT) -> DataFrame:
    return pro.withColumn("pd_profile", pd_profile()).withColumn(
        "el", F.col("pd_profile") * (F.col("balance") * (1 - F.col("guarantee"))) * F.lit(lgd)
    )


def portfolio_loss(el: DataFrame) -> DataFrame:
    """Loss rate per month and the share of the balance it covers, in one aggregation. Only rows with a
    profile probability count as covered; a month without any is left out."""
    covered = F.col("pd_profile").isNotNull()
    months = el.groupBy("time").agg(
        sum_or_zero(F.when(covered, F.col("el"))).alias("el_portfolio"),
        sum_or_zero(F.when(covered, F.col("balance"))).alias("port_balance"),
        sum_or_zero("balance").alias("p_balance_all"),
        F.count_if(covered).alias("__n"),
    )
    return months.filter(F.col("__n") > 0).select(
        "time",
        "el_portfolio",
        "port_balance",
        ratio(F.col("el_portfolio"), F.col("port_balance")).alias("port_loss"),
        "p_balance_all",
        ratio(F.col("port_balance"), F.col("p_balance_all")).alias("portfolio_with_data"),
    )


def loan_loss_output(el: DataFrame) -> DataFrame:
    """The per-loan result: id, month, balance, the columns from pd to the category, then the loss."""
    middle = select_range(el, "pd", "risk_category").columns
    return el.select("loan_id", "time", "balance", *middle, "pd_profile", "el")


def category_share_by_month(el: DataFrame) -> DataFrame:
    """Share of each category in the month's balance."""
    return category_share(el, "time", "risk_category", "balance")

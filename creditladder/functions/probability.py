"""Probabilities along the ladder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import col, if_known

# Migration probabilities in ladder order, as named by the scored frames.
MIGRATIONS = ("pm_sm", "pm_substandard", "pm_doubtful", "pm_wo")
CATEGORIES = ("Current", "Special Mention", "Substandard", "Doubtful")


def inverse_logit(eta: Column) -> Column:
    return 1 / (1 + F.exp(-eta))


def product(cols: Sequence[str | Column]) -> Column:
    out = col(cols[0])
    for c in cols[1:]:
        out = out * col(c)
    return out


def by_category(category: str | Column, values: Sequence[Column]) -> Column:
    """One value per rung, chosen by the category label; null for any other or unknown label."""
    category = col(category)
    out = F.lit(None).cast("double")
    for label, value in reversed(list(zip(CATEGORIES, values))):
        out = if_known(category == label, value, out)
    return out


def chain_products(migrations: Sequence[str] = MIGRATIONS) -> dict[str, Column]:
    """Write-off probability given each rung, and ``pdx`` from the first rung on."""
    return {
        "pd_sm": product(migrations[1:]),
        "pd_substandard": product(migrations[2:]),
        "pd_doubtful": product(migrations[3:]),
        "pdx": product(migrations),
    }


def active_pd(category: str | Column, migrations: Sequence[str] = MIGRATIONS) -> Column:
    """Product of the migrations still ahead of the loan."""
    return by_category(category, [product(migrations[i:]) for i in range(4)])


def active_pd_from_flags(flags: Sequence[str], migrations: Sequence[str] = MIGRATIONS) -> Column:
    """As :func:`active_pd`, chosen by the 0/1 rung flags in ladder order."""
    out = F.lit(None).cast("double")
    for i in reversed(range(4)):
        out = if_known(col(flags[i]) == 1, product(migrations[i:]), out)
    return out


def next_downgrade(category: str | Column, migrations: Sequence[str] = MIGRATIONS, compat: bool = False) -> Column:
    """Probability of the next step down. ``compat`` keeps an old reporting habit in which every rung
    below the first reads the probability of the rung above it."""
    picks = [0, 0, 1, 2] if compat else [0, 1, 2, 3]
    return by_category(category, [col(migrations[i]) for i in picks])

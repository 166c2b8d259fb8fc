from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import col


def month_end(d: str | Column) -> Column:
    return F.last_day(col(d))


def month_start(d: str | Column) -> Column:
    return F.trunc(col(d), "MM")


def years_between(end: str | Column, start: str | Column) -> Column:
    """Days divided by 365."""
    return F.datediff(col(end), col(start)) / F.lit(365.0)

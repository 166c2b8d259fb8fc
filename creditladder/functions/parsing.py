"""Raw text -> typed value. Junk never fails a job: it becomes null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import col

# The date layouts that occur in the exports.
US_DATE = "M/d/yyyy"
DAY_MONTH_NAME = "d-MMM-yyyy"
COLUMN_NAME_DATE = "'X'M.d.yyyy"

# Report roll-up labels that stand where a loan id would.
ROLLUP_LABELS = ("Total LoanID (Rollup)", "LoanID (Rollup)", "LoanID (Uncategorized)")


def text(c: str | Column) -> Column:
    """Text field rule: a blank field is the empty string, the letters NA mean unknown."""
    c = col(c)
    return F.when(c == "NA", F.lit(None).cast("string")).otherwise(F.coalesce(c, F.lit("")))


def parse_date(c: str | Column, fmt: str = US_DATE) -> Column:
    """Date text; leading blanks and what follows a US date, such as a time of day, are ignored."""
    c = F.ltrim(col(c))
    if fmt == US_DATE:
        c = F.regexp_extract(c, r"^\d{1,2}/\d{1,2}/\d{4}", 0)
    return F.try_to_date(c, fmt)


def parse_month_label(c: str | Column) -> Column:
    """'Jan-2016' -> 2016-01-01."""
    return parse_date(F.concat(F.lit("1-"), col(c)), DAY_MONTH_NAME)


def parse_number(c: str | Column) -> Column:
    """'1,234.5' -> 1234.5"""
    return F.regexp_replace(col(c), ",", "").try_cast("double")


def parse_int(c: str | Column) -> Column:
    """Whole numbers, also when written '6.0'."""
    return col(c).try_cast("double").try_cast("int")


def parse_percent(c: str | Column) -> Column:
    """'85%' -> 0.85"""
    return F.regexp_replace(col(c), "%", "").try_cast("double") / 100


def parse_id(c: str | Column) -> Column:
    """Id text -> bigint. '12.0' and ' 12 ' count as 12; anything else that is no whole number is null."""
    return F.regexp_replace(F.trim(col(c)), r"\.0*$", "").try_cast("bigint")


def canonical_label(c: str | Column) -> Column:
    """Category label without trailing blanks ('Substandard ' and 'Substandard' are one category)."""
    return F.rtrim(col(c))

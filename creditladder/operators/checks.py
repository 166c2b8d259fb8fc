"""Data checks; each returns its finding as rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import semi


def expect_covered(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """One row: is every key of ``df`` present in ``other``, and is it unique in ``df``?"""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    covered = semi(per_key.withColumnRenamed(key, "k"), other.select(F.col(key).alias("k")), "k")
    all_keys = per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_keys"))
    hit = covered.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    return all_keys.withColumn("n_covered", hit).select(
        "n_rows", "n_keys", "n_covered", ((F.col("n_covered") == F.col("n_keys")) & (F.col("n_rows") == F.col("n_keys"))).alias("ok")
    )


def tagged_rows(df: DataFrame, rules: Mapping[str, Column], keep: list[str], tag: str) -> DataFrame:
    """The rows that break each rule, one output row per broken rule, from one pass."""
    broken = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))
    return df.select(*keep, F.explode(broken).alias(tag))


def missing_report(df: DataFrame, key: str, cols: Mapping[str, str]) -> DataFrame:
    """Keys of rows with a null: ``cols`` maps reason -> column."""
    return tagged_rows(df, {reason: F.col(c).isNull() for reason, c in cols.items()}, [key], "missing")

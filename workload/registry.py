"""Query registration: each query with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditladder.session import cut_lineage

from .fixtures import view

Query = Callable[[SparkSession, str], DataFrame]

# Digits kept in comparisons.
MONEY, RATE, COEF = 2, 6, 4

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


@dataclass(frozen=True)
class Inputs:
    """The views over one data folder by name; each table is opened once per query."""

    spark: SparkSession
    sf_dir: str
    opened: dict[str, DataFrame] = field(default_factory=dict)

    def __call__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name, self.opened)

    def store(self, name: str) -> None:
        """Writes a view to the shared folder; it and the views over it that are opened from now on are read from there."""
        self.opened[name] = cut_lineage(self(name), name)


def query(name: str, sql: str | None = None):
    """Register ``fn(inputs) -> DataFrame`` and its SQL (None: rows only)."""

    def wrap(fn: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Round the named columns, others as they are."""
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})

"""Stored panels that serve both readings: by month (only the months asked for are scanned) and by loan (steps along a
loan's months, and joins on the loan, find the rows already dealt out and need no exchange).

Rows lie in one folder per month, and inside it in a fixed number of files by the loan's hash. What the reader must know
of that is stored beside the data, so a reader in another session cannot get it wrong.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from hashlib import sha256

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import cut_lineage


def _table_name(path: str) -> str:
    return f"laid_out_{sha256(path.encode()).hexdigest()[:16]}"


def write_by_key(
    df: DataFrame, path: str, key: str, month: str, buckets: int, observe: tuple[Observation, Sequence[Column]] | None = None
) -> DataFrame:
    """Stores ``df`` (replacing what is there) and returns it read back. Rows travel once, to the bucket of their key, so a
    month's folder holds one file per bucket; keys should be many and have few rows per month each."""
    spark = df.sparkSession
    dealt = df.repartition(buckets, key)
    if observe:
        dealt = dealt.observe(observe[0], *observe[1])
    name = _table_name(path)
    spark.sql(f"drop table if exists {name}")
    dealt.write.mode("overwrite").partitionBy(month).bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    layout = spark.createDataFrame([(key, month, buckets, df.schema.json())], "key string, month string, buckets int, columns string")
    layout.coalesce(1).write.mode("overwrite").parquet(f"{path}.layout")
    return read_by_key(spark, path)


def read_by_key(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows, with their columns in the order in which they were written."""
    layout = spark.read.parquet(f"{path}.layout").first()
    name = _table_name(path)
    if not spark.catalog.tableExists(name):
        schema = StructType.fromJson(json.loads(layout.columns))
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(
            f"create table {name} ({columns}) using parquet partitioned by (`{layout.month}`) "
            f"clustered by (`{layout.key}`) sorted by (`{layout.key}`) into {layout.buckets} buckets location '{path}'"
        )
    spark.catalog.refreshTable(name)
    return spark.table(name)


def replace_months(df: DataFrame, path: str, month: str, months: Sequence) -> None:
    """Replaces the given months of a table that is stored by month, and no others.

    The rows are computed and stored aside first, so a run that fails leaves the table as it was; then the months' folders
    are exchanged when all their files are written. Rows of another month, or a month without rows (whose old
    ones would stay), fail the run before anything is touched.
    """
    spark = df.sparkSession
    staged = cut_lineage(df, "staged")
    wanted = set(months)
    # The staged months are compared with a given list; one more than the list is enough to tell.
    found = {r[0] for r in staged.select(month).distinct().limit(len(wanted) + 1).collect()}
    if found != wanted:
        raise ValueError(f"rows for months {sorted(map(str, found))}, to be replaced: {sorted(map(str, wanted))}")
    stored = spark.read.parquet(path)
    missing = [c for c in stored.columns if c not in staged.columns]
    if missing or len(stored.columns) != len(staged.columns):
        raise ValueError(f"columns {staged.columns}, stored are {stored.columns}")
    rows = staged.select(*[F.col(c).cast(stored.schema[c].dataType) for c in stored.columns]).hint("rebalance", month)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(month).parquet(path)

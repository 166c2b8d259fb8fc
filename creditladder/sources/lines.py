"""Reading CSV exports: all fields as text, header names made safe, file order kept where it matters."""

from __future__ import annotations

import csv
import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .records import numbered_records


def safe_name(header: str) -> str:
    """Header text -> column name: other characters become dots, and a name that would not start with a
    letter or dot gets an X in front ('Loan ID' -> 'Loan.ID', '% Guaranteed' -> 'X..Guaranteed')."""
    prefix = "" if re.match(r"[A-Za-z.]", header) else "X"
    return prefix + re.sub(r"[^A-Za-z0-9._]", ".", header)


def safe_names(headers: list[str]) -> list[str]:
    """Safe names, made distinct with a running number."""
    seen: dict[str, int] = {}
    out = []
    for name in map(safe_name, headers):
        n = seen.get(name, 0)
        seen[name] = n + 1
        out.append(f"{name}.{n}" if n else name)
    return out


def numbered(rows: DataFrame, keep: Column | None = None) -> DataFrame:
    """The rows of a file scan, or those for which ``keep`` holds, with a dense 0-based ``_ord`` in file order
    (files by name).

    The scan runs once: its rows are stored with their input split and their place in it, and everything
    else reads the stored rows, so it does not matter how the file would be split at another time. A table with
    one row per split supplies the offsets; it is stored as well, so that its size is known and the rows stay
    where they are as long as it is small. Only that table (bytes / split size rows) meets a one-task window.
    A row without an offset fails the job.
    """
    split = ["_path", "_start"]
    columns = rows.columns
    placed = rows.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"))
    placed = placed if keep is None else placed.filter(keep)
    stored = cut_lineage(placed.withColumn("_pos", F.monotonically_increasing_id()), "rows")
    sizes = stored.groupBy(*split).agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    above = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*split, (F.coalesce(F.sum("_n").over(above), F.lit(0)) - F.col("_first")).alias("_shift"))
    joined = stored.join(cut_lineage(offsets, "offsets"), split, "left")
    known = F.assert_true(F.col("_shift").isNotNull(), F.lit("a row's input split has no offset")).isNull()
    return joined.filter(known).select((F.col("_pos") + F.col("_shift")).alias("_ord"), *[F.col(f"`{c}`") for c in columns])


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """The non-blank lines of a file (or a folder of part files, by name) with a dense 0-based ``_ord``."""
    return numbered(spark.read.text(path), F.trim("value") != "")


def first_lines(spark: SparkSession, path: str, n: int) -> list[str]:
    """The first ``n`` non-blank lines of the first file; only the top of that file is read."""
    first = min(spark.read.text(path).inputFiles())
    return [r.value for r in spark.read.text(unquote(first)).filter(F.trim("value") != "").take(n)]


def read_export(spark: SparkSession, path: str, skip: int = 0, ordered: bool = False, line_breaks: bool = False) -> DataFrame:
    """A CSV export with a header, every field as text under its safe name.

    ``skip`` title lines stand above the header. ``ordered`` adds ``_ord``, the 0-based position of the
    data row in the file; it is implied by ``skip``. ``line_breaks``: quoted fields may hold line breaks (which come out
    as line feeds); the records are found in parallel, see :func:`numbered_records`. Without it an ordered read fails
    on a line whose quotes do not close. A compressed file is one split in any case.
    """
    if line_breaks:
        records = numbered_records(spark, path)
        top = {r._ord: r.value for r in records.filter(F.col("_ord") <= skip).collect()}
        if skip not in top:
            raise ValueError(f"{path}: no header line after {skip} title lines")
        df = _parsed(records, top[skip], skip)
        return df if skip or ordered else df.drop("_ord")
    if not (skip or ordered):
        df = spark.read.csv(path, header=True, inferSchema=False, escape='"')
        return df.toDF(*safe_names(df.columns))
    top = first_lines(spark, path, skip + 1)
    if len(top) <= skip:
        raise ValueError(f"{path}: no header line after {skip} title lines")
    closed = F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 0
    whole = F.assert_true(closed, F.lit("a quoted field holds a line break: read this export with line_breaks=True")).isNull()
    return _parsed(ordered_lines(spark, path).filter((F.col("_ord") <= skip) | whole), top[skip], skip)


def _parsed(records: DataFrame, header: str, skip: int) -> DataFrame:
    """The records (_ord, value) below the header as columns under its names, numbered from 0."""
    names = safe_names(next(csv.reader([header])))
    schema = ", ".join(f"`{n}` string" for n in names)
    parsed = records.filter(F.col("_ord") > skip).select(
        (F.col("_ord") - skip - 1).alias("_ord"), F.from_csv("value", schema, {"escape": '"', "multiLine": "true"}).alias("r")
    )
    return parsed.select("_ord", *[F.col("r")[n].alias(n) for n in names])

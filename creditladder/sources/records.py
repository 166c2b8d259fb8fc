"""Records of CSV files whose quoted fields may hold line breaks, found in parallel.

A file is scanned in splits, line by line. Whether a line starts a record depends on whether it starts inside a
quoted field, which only the text above it tells. So every line is looked at for both cases: it maps
(outside, inside) to the state after it and is thus one of four functions, which are composed along the lines:

* *keep* leaves the state as it is, *swap* reverses it, *out* and *in* set it, whatever it was.

The state after any run of lines follows from its last *out* or *in* and the parity of the *swap*s after it.
Inside a split that is a window over its lines (a split is bounded by its size); over the splits of a
file it is the same window again over a table with one row per split, which also adds up the records. No line travels
further than to its split's task, but those of records that span lines, which meet by their record number.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import cut_lineage

# A field of a line, quoted (with what may follow the closing quote) or plain, and a line that ends
# outside quotes when it starts outside. Possessive, so that a doubled quote never counts as a closing one.
FIELD = r'(?:"(?:[^"]++|"")*+"(?!")[^,]*+|[^",][^,]*+|)'
ENDS_OUTSIDE = rf"^{FIELD}(?:,{FIELD})*+$"

#: A record of more lines than this fails the job: a quote that is no opening one has swallowed the lines after it.
MOST_LINES = 100_000

SPLIT = ["_path", "_start"]


def ends_inside(line: Column, starts_inside: bool) -> Column:
    """Does the line end inside a quoted field? A line that starts inside one is like one with a quote in front."""
    return ~(F.concat(F.lit('"'), line) if starts_inside else line).rlike(ENDS_OUTSIDE)


def _composed(df: DataFrame, window: WindowSpec, low: str, high: str, out: Mapping[str, Column]) -> DataFrame:
    """Composes the functions (``low``, ``high``: the state after a row from outside and from inside) along ``window``, which
    ends at the current row; ``out`` names columns for the state after it, by the state before the first row."""
    sets = F.col(low) == F.col(high)
    df = df.withColumn("_swaps", F.sum((F.col(low) & ~F.col(high)).cast("long")).over(window))
    last = F.last(F.when(sets, F.struct(F.col(low).alias("state"), F.col("_swaps").alias("swaps"))), ignorenulls=True)
    df = df.withColumn("_last", last.over(window))
    odd = (F.col("_swaps") - F.coalesce("_last.swaps", F.lit(0))) % 2 == 1
    return df.withColumns({name: F.coalesce("_last.state", entering) != odd for name, entering in out.items()}).drop("_swaps", "_last")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines with their split and place in it; both states after them, and per state before their split whether a
    line starts inside (``in0``, ``in1``) and how many records started up to it (``n0``, ``n1``)."""
    line = F.regexp_replace("value", "\r$", "")
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_pos"),
        line.alias("value"),
        ends_inside(line, False).alias("low"),
        ends_inside(line, True).alias("high"),
    )
    own = Window.partitionBy(*SPLIT).orderBy("_pos")
    so_far = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = _composed(lines, so_far, "low", "high", {"out0": F.lit(False), "out1": F.lit(True)})
    lines = lines.withColumns({f"in{k}": F.coalesce(F.lag(f"out{k}").over(own), F.lit(bool(k))) for k in (0, 1)})
    starts = {k: (~F.col(f"in{k}") & (F.trim("value") != "")).cast("long") for k in (0, 1)}
    return lines.withColumns({f"n{k}": F.sum(starts[k]).over(so_far) for k in (0, 1)})


def _splits(lines: DataFrame) -> DataFrame:
    """(path, start, inside, before): does the split start inside quotes, and how many records start before it in all files
    (by name)? A file that ends inside quotes fails the job."""
    ends = lines.groupBy(*SPLIT).agg(F.max_by(F.struct("out0", "out1", "n0", "n1"), "_pos").alias("end"))
    of_file = Window.partitionBy("_path").orderBy("_start")
    up_to = of_file.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    states = _composed(ends.select(*SPLIT, "end.*"), up_to, "out0", "out1", {"after": F.lit(False)})
    states = states.withColumns({"inside": F.coalesce(F.lag("after").over(of_file), F.lit(False)), "next": F.lead("_start").over(of_file)})
    closed = F.assert_true(F.col("next").isNotNull() | ~F.col("after"), F.concat(F.lit("a quoted field does not close in "), "_path"))
    records = F.when(F.col("inside"), F.col("n1")).otherwise(F.col("n0"))
    above = Window.orderBy(*SPLIT).rowsBetween(Window.unboundedPreceding, -1)
    return states.filter(closed.isNull()).select(*SPLIT, "inside", F.coalesce(F.sum(records).over(above), F.lit(0)).alias("before"))


def numbered_records(spark: SparkSession, path: str) -> DataFrame:
    """(_ord, value): the records of a file (or a folder of files, by name) with their dense 0-based position, in
    which line breaks inside quotes are kept. Lines that are blank outside quotes are no records.

    The scan runs once and its lines are stored, as is the table of splits (bytes / split size rows), so that later
    steps do not depend on how the file would be split at another time. Quotes count as the CSV reader takes them: one at
    the start of a field opens it, a doubled one stays inside, others mean nothing. A compressed file is one split.
    """
    lines = cut_lineage(_lines(spark, path), "lines")
    placed = lines.join(cut_lineage(_splits(lines), "splits"), SPLIT, "left")
    known = F.assert_true(F.col("before").isNotNull(), F.lit("a line's input split has no offset")).isNull()
    pick = {name: F.when(F.col("inside"), F.col(f"{name}1")).otherwise(F.col(f"{name}0")) for name in ("in", "out", "n")}
    told = placed.filter(known).select(*SPLIT, "_pos", "value", (F.col("before") + pick["n"] - 1).alias("_ord"), pick["in"].alias("starts_in"), pick["out"].alias("ends_in"))
    whole = told.filter(~F.col("starts_in") & ~F.col("ends_in") & (F.trim("value") != "")).select("_ord", "value")
    parts = told.filter(F.col("starts_in") | F.col("ends_in"))
    joined = parts.groupBy("_ord").agg(F.sort_array(F.collect_list(F.struct("_start", "_pos", "value"))).alias("lines"))
    short = F.assert_true(F.size("lines") <= MOST_LINES, F.lit(f"a record has more than {MOST_LINES} lines")).isNull()
    spread = joined.filter(short).select("_ord", F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("value"))
    return whole.union(spread)

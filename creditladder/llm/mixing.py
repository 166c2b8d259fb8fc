"""Mixing sources to target weights by Pfair scheduling of blocks.

Time is cut into slots of one block each. A source of weight w (a whole number of slots per period) gives its
j-th block the window from floor((j-1)/w) to ceil(j/w), in slots; earliest deadline first fills one period,
which then repeats. At every slot each source has had its share to within less than one block.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slots per period: weights are whole numbers of slots in it, and it bounds the number of sources.
PERIOD = 1000
BLOCK_ROWS = 64
#: Without given weights a source weighs (its rows) ** EXPONENT: below 1, small sources gain.
EXPONENT = 0.9
#: Hex digits of the order hash that split a source's numbering into parts.
PART_DIGITS = 3


NEW_COLUMNS = ("mix_copy", "mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_position")


def whole_shares(weights: list[float], period: int = PERIOD) -> list[int]:
    """Weights as whole numbers that sum to ``period``, one at least: largest remainders get what is left,
    ties go to the earlier."""
    if len(weights) > period:
        raise ValueError(f"{len(weights)} sources; a period has room for {period}")
    total = sum(weights)
    exact = [1 + w / total * (period - len(weights)) for w in weights]
    shares = [math.floor(x) for x in exact]
    for i in sorted(range(len(exact)), key=lambda i: (shares[i] - exact[i], i))[: period - sum(shares)]:
        shares[i] += 1
    return shares


def window(block: int, share: int, period: int = PERIOD) -> tuple[int, int]:
    """Release and deadline of a source's block (numbered from 0), in slots."""
    return block * period // share, -(-(block + 1) * period // share)


def period_slots(shares: list[int], period: int = PERIOD) -> list[list[int]]:
    """For each source the slots of its blocks in one period: earliest deadline first among released blocks,
    ties to the earlier source."""
    released = sorted((window(j, c, period)[0], window(j, c, period)[1], s) for s, c in enumerate(shares) for j in range(c))
    slots: list[list[int]] = [[] for _ in shares]
    ready: list[tuple[int, int]] = []
    at = 0
    for t in range(sum(shares)):
        while at < len(released) and released[at][0] <= t:
            heapq.heappush(ready, released[at][1:])
            at += 1
        slots[heapq.heappop(ready)[1]].append(t)
    return slots


def source_key(col: str) -> Column:
    """The source as a text that is never null; rows without a source form one of their own."""
    return F.when(F.col(col).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(col).cast("string")))


def plan(counts: dict[str, int], weights: dict[str, float] | None, block_rows: int, exponent: float, period: int) -> list[tuple]:
    """(source, rows, share, blocks, slots in a period) of every source. The mix is as long as it must be for
    every source to have given all its rows; shorter sources start again."""
    names = sorted(counts)
    given = [float(weights[n[1:]]) for n in names] if weights else [counts[n] ** exponent for n in names]
    shares = whole_shares(given, period)
    slots = period_slots(shares, period)

    def slot(s: int, block: int) -> int:
        return block // shares[s] * period + slots[s][block % shares[s]]

    length = max((slot(s, -(-counts[n] // block_rows) - 1) + 1 for s, n in enumerate(names)), default=0)
    blocks = [length // period * c + sum(x < length % period for x in own) for c, own in zip(shares, slots)]
    return [(n, counts[n], c, b, own) for n, c, b, own in zip(names, shares, blocks, slots)]


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    block_rows: int = BLOCK_ROWS,
    exponent: float = EXPONENT,
    period: int = PERIOD,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """The rows with ``mix_copy``, ``mix_block``, ``mix_release``, ``mix_deadline``, ``mix_slot`` and
    ``mix_position`` (dense, from 0): the place of each row in the mix.

    Every row occurs at least once; rows of sources that are short for their weight occur again as
    further copies until the longest source is through. Inside a source rows go in the order of the MD5
    of their id. Its numbering is done in ``16 ** PART_DIGITS`` parts with a table of part sizes, so no
    source meets one task. The schedule is made on the driver from one row per source; up to ``period`` sources it is
    broadcast, beyond that the period grows in whole multiples and the table is joined like any other. Null sources are one source, null ids one id; rows with equal ids are ordered by all
    their columns; empty table: no rows. Columns named like the new ones are replaced.
    """
    kept = [c for c in docs.columns if c not in NEW_COLUMNS]
    h = F.coalesce(F.md5(F.col(id_col).cast("string").cast("binary")), F.lit("-"))
    keyed = docs.select(F.struct(*kept).alias("row"), source_key(source_col).alias("src"), h.alias("h"), F.col(id_col).alias("id"))
    keyed = keyed.withColumn("part", F.substring("h", 1, PART_DIGITS))
    sizes = docs.select(source_key(source_col).alias("src"), F.substring(h, 1, PART_DIGITS).alias("part")).groupBy("src", "part").count()
    found = sizes.groupBy("src").agg(F.sum("count")).collect()
    few = len(found) <= period
    # A period has room for every source.
    period *= max(1, -(-len(found) // period))
    planned = plan({r[0]: r[1] for r in found}, weights, block_rows, exponent, period)
    schema = "src string, n long, share int, blocks long, slots array<int>"
    sources = docs.sparkSession.createDataFrame(planned, schema)
    before = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("src", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("src", "part").orderBy("h", "id", F.xxhash64("row"))
    numbered = keyed.withColumn("i", F.row_number().over(inside) - 1).join(offsets, ["src", "part"]).join(F.broadcast(sources) if few else sources, "src")
    first = F.col("i") + F.col("offset")
    copies = F.ceil((F.col("blocks") * block_rows - first) / F.col("n"))
    placed = numbered.withColumn("first", first).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    at = F.col("first") + F.col("copy") * F.col("n")
    placed = placed.withColumn("at", at).withColumn("block", F.floor(at / block_rows))
    in_period = F.element_at("slots", (F.col("block") % F.col("share") + 1).cast("int"))
    slot = F.floor(F.col("block") / F.col("share")) * period + in_period
    return placed.select(
        "row.*",
        F.col("copy").alias("mix_copy"),
        F.col("block").alias("mix_block"),
        F.floor(F.col("block") * period / F.col("share")).alias("mix_release"),
        F.ceil((F.col("block") + 1) * period / F.col("share")).alias("mix_deadline"),
        slot.alias("mix_slot"),
        (slot * block_rows + F.col("at") % block_rows).alias("mix_position"),
    )


def in_order(mixed: DataFrame) -> DataFrame:
    """The mix by position, spread over tasks, so that files read in name order hold it in order."""
    return mixed.repartitionByRange("mix_position").sortWithinPartitions("mix_position")

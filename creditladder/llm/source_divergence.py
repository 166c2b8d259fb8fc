"""Audit of how far the sources of a language differ in their words.

Every source gives each kept term of its language a smoothed share p (a whole number of billionths). Two sources differ by
the sum of |p - p'| over all kept terms. Most counts are 0, so the sum is taken as if all of them were, and
corrected where they are not:

* a source with n occurrences of a term differs from another's share at 0; counted once per source and share;
* where both have the term, a second correction holds, and these come from a frequent-pattern tree: a term's nonzero
  counts, in one order of the sources, are a path, and terms that begin alike share nodes with their
  multiplicity. Each node is met with each of its ancestors once, however many terms run through it.

Paths are sorted, so a task sees a run of like paths; its trees hold one batch of paths each, and their corrections
add up to those of the whole tree. All arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage

LEAST_DOCS = 30
TOP_TERMS = 50
ADDED = 5
SCALE = 1_000_000_000
#: Items of a path by which tasks are told apart.
RANGE_ITEMS = 4
#: Distinct (lang, source, term) that a task holds before it passes them on.
HELD_TERMS = 300_000

#: Bytes of terms: ASCII letters, capitals folded, and everything outside ASCII; others become blanks.
TERM_BYTES = bytes(
    b | 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def count_terms(rows: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of rows (lang, source, text, no nulls), counted per task: a key may come from
    several tasks, and several times from one."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: dict[tuple[str, str], Counter] = defaultdict(Counter)
        docs: dict[tuple[str, str], Counter] = defaultdict(Counter)

        def passed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in times.items():
                terms = pa.array(list(counts), pa.binary()).cast(pa.string())
                of = docs[lang, source]
                names = [pa.array([name], pa.string()).take(pa.nulls(len(terms), pa.int32()).fill_null(0)) for name in (lang, source)]
                numbers = [pa.array(list(counts.values()), pa.int64()), pa.array([of[t] for t in counts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*names, terms, *numbers], ["lang", "source", "term", "n", "docs"])
            times.clear()
            docs.clear()

        held = 0
        for batch in batches:
            lang, source = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for i, text in enumerate(batch.column("text").cast(pa.binary())):
                terms = text.as_py().translate(TERM_BYTES).split()
                key = lang[i], source[i]
                counts = times[key]
                held -= len(counts)
                counts.update(terms)
                docs[key].update(set(terms))
                held += len(counts)
                if held >= HELD_TERMS:
                    yield from passed_on()
                    held = 0
        yield from passed_on()

    return rows.mapInArrow(scan, "lang string, source string, term string, n long, docs long")


def kept_terms(rows: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, everywhere, first) of the terms in at least ``least_docs`` rows of their language, for the sources
    that have them; ``everywhere`` is the language's count, ``first`` holds in one row of each term. One exchange, of
    counts; a term has at most one row per source after it."""
    counted = count_terms(rows).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    full = counted.withColumns(
        {"all_docs": F.sum("docs").over(term), "everywhere": F.sum("n").over(term), "first": F.min("source").over(term) == F.col("source")}
    )
    return full.filter(F.col("all_docs") >= least_docs).select("lang", "source", "term", "n", "everywhere", "first")


def share(n: Column, total: Column, terms: Column, added: int = ADDED) -> Column:
    """1 + floor(SCALE * (n + added) / (total + added * terms)), exact; null without terms."""
    over = F.lit(SCALE).cast("decimal(10,0)") * (n + added).cast("decimal(19,0)")
    under = F.nullif((total + added * terms).cast("decimal(19,0)"), F.lit(0).cast("decimal(19,0)"))
    return (1 + F.call_function("div", over, under)).cast("long")


def source_table(rows: DataFrame, kept: DataFrame, added: int = ADDED) -> DataFrame:
    """(lang, source, total, terms, lang_total, zero, place) of every source that occurs: its count over kept terms, the
    language's number of kept terms and count, the share of a term that the source lacks, and the source's
    place in the order of paths, sources with most terms first."""
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("has"), F.count_if("first").alias("firsts"))
    every = rows.select("lang", "source").distinct().join(own, ["lang", "source"], "left").na.fill(0)
    of_lang = every.groupBy("lang").agg(F.sum("firsts").alias("terms"), F.sum("total").alias("lang_total"))
    order = Window.partitionBy("lang").orderBy(F.desc("has"), "source")
    return every.join(of_lang, "lang").select(
        "lang", "source", "total", "terms", "lang_total",
        share(F.lit(0), F.col("total"), F.col("terms"), added).alias("zero"),
        F.row_number().over(order).alias("place"),
    )


def tree(paths: list[list[tuple]]) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the tree of paths, lists of items (place, n, p, zero): the item of each node, and (parents or -1,
    multiplicities). Each path is entered beside the one before it, so like paths should be neighbours."""
    items: list[tuple] = []
    parents: list[int] = []
    times: list[int] = []
    before: list[tuple] = []
    nodes: list[int] = []
    for path in paths:
        same = 0
        for a, b in zip(path, before):
            if a != b:
                break
            same += 1
        del nodes[same:]
        for node in nodes:
            times[node] += 1
        for item in path[same:]:
            parents.append(nodes[-1] if nodes else -1)
            nodes.append(len(items))
            items.append(item)
            times.append(1)
        before = path
    return np.array(items, np.int64).reshape(len(items), 4), np.array([parents, times], np.int64)


def pair_corrections(items: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (low * 2**31 + high) of pairs of sources, and what both having a term adds to their sum."""
    place, _, p, zero = items.T
    parent, times = links
    keys, values = [], []
    node, above = np.flatnonzero(parent >= 0), parent[parent >= 0]
    while len(node):
        a, b = p[node], p[above]
        both = np.abs(a - b) - np.abs(a - zero[above]) - np.abs(zero[node] - b) + np.abs(zero[node] - zero[above])
        keys.append((place[above] << 31) + place[node])
        values.append(times[node] * both)
        go_on = parent[above] >= 0
        node, above = node[go_on], parent[above[go_on]]
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs, of = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.zeros(len(pairs), np.int64)
    np.add.at(sums, of, np.concatenate(values))
    return pairs, sums


def shared_terms(scored: DataFrame) -> DataFrame:
    """(lang, low, high, value): corrections of the pairs of sources (by place) over the terms that both have."""
    item = F.struct("place", "n", "p", "zero")
    paths = scored.groupBy("lang", "term").agg(F.sort_array(F.collect_list(item)).alias("path")).select("lang", "path")
    # The range's sample of rows goes to the driver, so it is taken on short beginnings.
    begin = F.transform(F.slice("path", 1, RANGE_ITEMS), lambda x: x["place"] * (1 << 32) + F.least(x["n"], F.lit((1 << 32) - 1)))
    paths = paths.filter(F.size("path") > 1).repartitionByRange("lang", begin).sortWithinPartitions("lang", "path")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, path = batch.column("lang").to_pylist(), batch.column("path")
            edges = path.offsets.to_numpy().tolist()
            flat = list(zip(*(path.values.field(c).to_pylist() for c in ("place", "n", "p", "zero"))))
            by_lang: dict[str, list] = defaultdict(list)
            for i, name in enumerate(lang):
                by_lang[name].append(flat[edges[i] : edges[i + 1]])
            for name, own in by_lang.items():
                pairs, sums = pair_corrections(*tree(own))
                columns = [pa.array([name] * len(pairs), pa.string()), pa.array(pairs >> 31), pa.array(pairs & (2**31 - 1)), pa.array(sums)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "low", "high", "value"])

    found = paths.mapInArrow(scan, "lang string, low long, high long, value long")
    return found.groupBy("lang", "low", "high").agg(F.sum("value").alias("value"))


def single_terms(scored: DataFrame, sources: DataFrame) -> DataFrame:
    """(lang, place, other, value) of all pairs of sources of a language: what the terms of ``place`` add if ``other``
    had none of them, and what the pair differs by if neither had any (in the lower place's row)."""
    # A source has fewer than sqrt(2 * total) different counts, so an array of them is small.
    shares = scored.groupBy("lang", "place", "p").count().groupBy("lang", "place").agg(F.collect_list(F.struct("p", "count")).alias("shares"))
    one = sources.select("lang", "place", "terms", "zero").join(shares, ["lang", "place"], "left")
    other = sources.select("lang", F.col("place").alias("other"), F.col("zero").alias("other_zero"))
    both = one.join(other, "lang").filter("place <> other")
    apart = F.abs(F.col("zero") - F.col("other_zero"))
    own = F.aggregate("shares", F.lit(0).cast("long"), lambda s, x: s + x["count"] * (F.abs(x["p"] - F.col("other_zero")) - apart))
    value = F.coalesce(own, F.lit(0)) + F.when(F.col("place") < F.col("other"), F.coalesce(F.col("terms") * apart, F.lit(0))).otherwise(0)
    return both.select("lang", "place", "other", value.alias("value"))


def divergence(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
    least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, added: int = ADDED,
) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) of ``docs``.

    Terms are runs of ASCII letters (capitals folded) and characters outside ASCII. A language keeps the terms that at least
    ``least_docs`` of its rows hold. Each source, and the language as a whole, gives a kept term the share ``share``.
    Part ``pair``: each other source of the language, with the sum of absolute differences of shares over all kept
    terms (0 without any). Part ``term``: the ``top`` terms that the source has, and has more of than
    the language, with the difference. Ranks run from 1 per source and part, by value downwards, then item (UTF-8).

    Null text, language and source are read as empty; repeated rows count each time; texts without terms still make
    their source occur; an empty table gives no rows. Other columns are not read. A language's pairs of sources
    are all in the result, so the number of sources must be one whose square can be written.
    """
    named = {"lang": lang_col, "source": source_col, "text": text_col}
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for name, c in named.items()])
    kept = cut_lineage(kept_terms(rows, least_docs), "kept_terms")
    sources = cut_lineage(source_table(rows, kept, added), "sources")
    scored = kept.join(sources, ["lang", "source"]).select(
        "lang", "source", "term", "place", "n", "zero",
        share(F.col("n"), F.col("total"), F.col("terms"), added).alias("p"),
        share(F.col("everywhere"), F.col("lang_total"), F.col("terms"), added).alias("q"),
    )

    single, shared = single_terms(scored, sources), shared_terms(scored)
    parts = [single, shared.select("lang", F.col("low").alias("place"), F.col("high").alias("other"), "value")]
    parts += [x.select("lang", F.col("other").alias("place"), F.col("place").alias("other"), "value") for x in parts]
    sums = parts[0].union(parts[1]).union(parts[2]).union(parts[3]).groupBy("lang", "place", "other").agg(F.sum("value").alias("value"))
    one = sources.select("lang", "place", "source")
    two = sources.select("lang", F.col("place").alias("other"), F.col("source").alias("item"))
    pairs = sums.join(one, ["lang", "place"]).join(two, ["lang", "other"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    more = scored.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).union(more.withColumn("rank", rank).filter(F.col("rank") <= top))

"""Similarity join of documents by the Jaccard coefficient of their word shingles, with adaptive multi-match
prefixes.

All shingles have one order: rarer before frequent (as far as counted), then by hash. Two sets that reach the
threshold share at least l shingles within the first n - ceil(t * n) + l of each. A document's l is 1, and higher
the more candidates its prefix would bring: the prefix is lengthened by l - 1 shingles, and a pair is only
verified when it shares the smaller of both l. As prefixes are cut for the smallest possible partner and a pair's
sizes are known when it is counted, it must share as many more as its own least overlap o exceeds that of
the sets (a set of n has n - prefix shingles outside its prefix, which bounds what is not counted). For the same reason a
pair only meets by a shingle among the first n - o + 1 of both. The steps:

1. every text's shingle set has a signature; rows of equal sets are one node, of which one text goes on;
2. all shingles of all sets are counted in the cluster; order and l follow from those that are frequent;
3. prefix rows meet by shingle; a shingle of one node only goes;
4. in rounds, each node of a crowded shingle is verified against one node of its largest component, drawn anew for each
   shingle and round, so large groups of near copies become components without pairs inside them; a shingle goes on
   as long as its own draws link nodes;
5. the remaining pairs, of different components, meet, are held against each other's prefixes, and verified; of each
   shingle's largest component the nodes only meet those outside it, and where many meet, prefixes are compared at once;
6. components give the smallest id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .components import components
from .shingles import shingle_sets, signatures
from .units import slices, text_column, tidy

PERCENT = 75
SLICE = 2 << 20
#: A task passes its shingles on for counting in runs of this many.
RUN = 4_000_000
#: A shingle of this many sets counts as frequent (copies of a set count once in a task); at most MOST_FREQUENT of them
#: (the most frequent) shape the order. The order never changes the result, so this bounds memory only.
REPORTED = 16
MOST_FREQUENT = 1 << 20
#: Parts per shuffle partition in which shingles are counted, each in one call.
COUNT_PARTS = 4
MOST_MATCHES = 8
#: Bits of a shingle's place in its prefix row, beside 30 for the set's size: a text in a column is shorter than 2 GB.
PLACE_BITS = 28
#: Step 4 looks at shingles of this many nodes or more, and ends after ROUNDS. Both affect cost, never the
#: result: step 5 takes whatever is left.
CROWD = 8
ROUNDS = 12
#: Parts in which the prefix rows of a frequent shingle are dealt out.
LOTS = 64
#: Step 5 compares prefixes already where nodes meet if a shingle has so many of them; longer prefixes than LISTED (their shared
#: shingles) are compared later, which affects cost only.
HOT = 64
LISTED = 128


def needed(n: int, percent: int = PERCENT) -> int:
    """Least overlap of a set of n with any set it reaches the threshold with."""
    return -(-n * percent // 100)


def matches(prefix_cost: float, base: int, n: int, percent: int = PERCENT) -> int:
    """Shared shingles to ask for: one more for each doubling of the mean cost of a prefix shingle (the number
    of texts reported with it) above 2."""
    extra = int(np.log2(max(1.0, prefix_cost / max(base, 1) / 2)))
    return max(1, min(1 + extra, MOST_MATCHES, needed(n, percent)))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            tokens, edges = shingle_sets(text_column(part.column("text")))
            yield part, tokens, edges, signatures(tokens, edges, 1)


def survey(rows: DataFrame) -> DataFrame:
    """For every row (id, key, text): (id, key, n, node, proof)."""
    id_type = rows.schema["id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, tokens, edges, node in _sets(batches):
            arrays = [np.diff(edges), node, signatures(tokens, edges, 2)]
            columns = [part.column("id"), part.column("key"), *[pa.array(x) for x in arrays]]
            yield pa.RecordBatch.from_arrays(columns, ["id", "key", "n", "node", "proof"])

    return rows.mapInArrow(tidy(scan), f"id {id_type}, key long, n long, node long, proof long")


def packed_tokens(tokens: np.ndarray) -> tuple[bytes, bytes]:
    """The distinct ones of 32-bit numbers and their counts, as bytes that compress: steps between neighbours, the first
    bytes of all of them before the second ones and so on."""
    values, times = np.unique(tokens, return_counts=True)
    planes = [np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for x in (np.diff(values, prepend=np.uint32(0)), times)]
    return planes[0], planes[1]


def unpacked_tokens(steps: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
    made = [np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1) for b in (steps, times)]
    return np.cumsum(made[0], dtype=np.uint64), made[1].astype(np.int64)


def frequent_tokens(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """The most frequent shingles of all sets, ascending, how many sets have each, and how many of their leading bits are
    kept: at most MOST_FREQUENT.

    Shingles are dealt by their first bits into parts that grow in number with the partitions, and told apart there
    by the next 32 bits; every shingle of the corpus is counted, and only frequent ones leave their part."""
    spark = rows.sparkSession
    bits = max(6, math.ceil(math.log2(COUNT_PARTS * int(spark.conf.get("spark.sql.shuffle.partitions")))))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        run: list[np.ndarray] = []
        held = 0

        def passed_on() -> pa.RecordBatch:
            tokens = np.sort(np.concatenate(run))
            run.clear()
            part = tokens >> np.uint64(64 - bits)
            starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            rest = (tokens >> np.uint64(32 - bits)).astype(np.uint32)
            packed = [packed_tokens(rest[a:b]) for a, b in zip(starts, [*starts[1:], len(tokens)])]
            arrays = [pa.array(part[starts].astype(np.int32)), *[pa.array([p[k] for p in packed], pa.binary()) for k in (0, 1)]]
            return pa.RecordBatch.from_arrays(arrays, ["part", "steps", "times"])

        for _, tokens, edges, node in _sets(batches):
            for i, x in enumerate(node.tolist()):
                if edges[i + 1] > edges[i] and x not in seen:
                    seen.add(x)
                    run.append(tokens[edges[i] : edges[i + 1]])
                    held += int(edges[i + 1] - edges[i])
            if held >= RUN:
                held = 0
                yield passed_on()
        if run:
            yield passed_on()

    def count(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = [unpacked_tokens(*packed) for batch in batches for packed in zip(batch.column("steps").to_pylist(), batch.column("times").to_pylist())]
        values, of = np.unique(np.concatenate([r[0] for r in runs]), return_inverse=True)
        times = np.bincount(of, weights=np.concatenate([r[1] for r in runs]), minlength=len(values)).astype(np.int64)
        often = times >= REPORTED
        token = (np.uint64(key[0].as_py()) << np.uint64(32)) | values[often]
        yield pa.RecordBatch.from_arrays([pa.array(token.astype(np.int64)), pa.array(times[often])], ["token", "times"])

    parts = rows.select("text").mapInArrow(tidy(scan), "part int, steps binary, times binary")
    totals = cut_lineage(parts.groupBy("part").applyInArrow(count, "token long, times long"), "frequent")
    sizes = sorted(totals.groupBy(F.floor(F.log2("times")).alias("size")).count().collect(), reverse=True)
    most, least = 0, 63
    for size, n in sizes:
        if most + n > MOST_FREQUENT:
            break
        most, least = most + n, size
    got = totals.filter(F.floor(F.log2("times")) >= least).toArrow() if most else None
    if got is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), bits + 32
    token, times = got.column("token").to_numpy().view(np.uint64), got.column("times").to_numpy()
    order = np.argsort(token)
    return token[order], times[order], bits + 32


def prefixes(rows: DataFrame, frequent: tuple[np.ndarray, np.ndarray, int], percent: int) -> DataFrame:
    """(token, node, info): the prefix of every node, once per task.

    ``info`` holds the size n of the node's set, ``place``, the shingle's place in the order of the set, ``asked``, the
    node's number of matches, and ``common``, which marks frequent shingles."""
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, times, bits = shared.value
        seen: set[int] = set()
        for _, tokens, edges, node in _sets(batches):
            cost = np.ones(len(tokens), np.int64)
            if len(common):
                short = tokens >> np.uint64(64 - bits)
                at = np.minimum(np.searchsorted(common, short), len(common) - 1)
                cost = np.where(common[at] == short, times[at], 1)
            out, info, of = [], [], []
            for i, x in enumerate(node.tolist()):
                a, b = edges[i], edges[i + 1]
                n = int(b - a)
                if not n or x in seen:
                    continue
                seen.add(x)
                own, weight = tokens[a:b], cost[a:b]
                if (weight > 1).any():
                    order = np.argsort(np.where(weight > 1, np.log2(weight).astype(int), 0), kind="stable")
                    own, weight = own[order], weight[order]
                base = n - needed(n, percent) + 1
                ask = matches(float(weight[:base].sum()), base, n, percent)
                size = base + ask - 1
                out.append(own[:size])
                info.append((n << PLACE_BITS + 5) | (np.arange(size) << 5) | (ask << 1) | (weight[:size] > 1))
                of.append(np.full(size, x))
            if out:
                arrays = [np.concatenate(out).view(np.int64), np.concatenate(of), np.concatenate(info).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in arrays], ["token", "node", "info"])

    return rows.select("text").mapInArrow(tidy(scan), "token long, node long, info long")


def _unpacked() -> list[Column]:
    info = F.col("info")
    return [
        F.shiftright(info, PLACE_BITS + 5).alias("n"),
        F.shiftright(info, 5).bitwiseAND((1 << PLACE_BITS) - 1).alias("place"),
        F.shiftright(info, 1).bitwiseAND(15).alias("asked"),
    ]


def verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) of nodes whose sets reach the threshold. Both texts meet in one row; their sets are
    made again there and compared exactly."""
    left = pairs.select("x", "y").join(texts.select(F.col("node").alias("x"), F.col("text").alias("text_x")), "x")
    both = left.join(texts.select(F.col("node").alias("y"), F.col("text").alias("text_y")), "y")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_y", SLICE):
                xs, xe = shingle_sets(text_column(part.column("text_x")))
                ys, ye = shingle_sets(text_column(part.column("text_y")))
                keep = []
                for i in range(part.num_rows):
                    a, b = xs[xe[i] : xe[i + 1]], ys[ye[i] : ye[i + 1]]
                    common = len(np.intersect1d(a, b, assume_unique=True))
                    keep.append(100 * common >= percent * (len(a) + len(b) - common))
                yield part.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return both.select("x", "y", "text_x", "text_y").mapInArrow(tidy(check), "x long, y long")


def _may_link(a: str, b: str, percent: int) -> Column:
    """The sizes of two prefix rows' sets allow a link, and the shingle counts for the matches asked of both."""
    asked = F.least(f"{a}.asked", f"{b}.asked")
    counts = [F.col(f"{x}.place") < F.col(f"{x}.n") - F.ceil(percent * F.col(f"{x}.n") / 100) + asked for x in (a, b)]
    return (100 * F.least(f"{a}.n", f"{b}.n") >= percent * F.greatest(f"{a}.n", f"{b}.n")) & counts[0] & counts[1]


def _overlap(a: str, b: str, percent: int) -> Column:
    """Shingles that two linked sets share at least."""
    return F.ceil(percent * (F.col(f"{a}.n") + F.col(f"{b}.n")) / (100 + percent))


def _least(a: str, b: str, percent: int) -> Column:
    """Prefix shingles that two linked sets share at least, when those count that the matches asked of both allow."""
    return F.least(f"{a}.asked", f"{b}.asked") + _overlap(a, b, percent) - F.ceil(percent * F.greatest(f"{a}.n", f"{b}.n") / 100)


def _first_shared(a: str, b: str, percent: int) -> Column:
    """The sizes allow a link, and the shingle lies where the first shared one of a link must be in both orders."""
    places = [F.col(f"{x}.place") <= F.col(f"{x}.n") - _overlap(a, b, percent) for x in (a, b)]
    return (100 * F.least(f"{a}.n", f"{b}.n") >= percent * F.greatest(f"{a}.n", f"{b}.n")) & places[0] & places[1]


def _enough(a: str, b: str, percent: int) -> Column:
    """Two whole prefixes (``list``, their shared shingles) have as many in common as a link needs."""
    needs = [_overlap(a, b, percent) - F.ceil(percent * F.col(f"{x}.n") / 100) + F.col(f"{x}.asked") for x in (a, b)]
    return F.size(F.array_intersect(f"{a}.list", f"{b}.list")) >= F.least(*needs)


def _met(placed: DataFrame, percent: int, more: Column | None = None) -> DataFrame:
    """Pairs (x, y) of nodes of different components that meet by a shingle of both prefixes, once for each; of its largest
    component only with others."""
    a, b = placed.filter("root <> main").alias("a"), placed.alias("b")
    meet = (
        (F.col("a.token") == F.col("b.token"))
        & (F.col("a.root") != F.col("b.root"))
        & ((F.col("b.root") == F.col("b.main")) | (F.col("a.node") < F.col("b.node")))
        & _first_shared("a", "b", percent)
    )
    return a.join(b, meet if more is None else meet & more).select(F.least("a.node", "b.node").alias("x"), F.greatest("a.node", "b.node").alias("y"))


def _candidates(placed: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) of nodes of different components whose prefixes allow a link; each once."""
    by_place = F.array_sort(F.collect_list(F.struct("place", "token")))
    lists = cut_lineage(placed.groupBy("node", "n", "asked").agg(by_place["token"].alias("list")), "lists")
    short = lists.filter(F.size("list") <= LISTED).select("node", "list")
    hot = placed.filter(F.col("nodes") >= HOT).join(short, "node", "left")
    # Prefixes have one order, so the first shingle that two lists share stands for all.
    shared = F.array_intersect("a.list", "b.list")
    once = F.coalesce((F.get(shared, F.lit(0)) == F.col("a.token")) & _enough("a", "b", percent), F.lit(True))
    pairs = _met(placed.filter(F.col("nodes") < HOT), percent).union(_met(hot, percent, once)).distinct()
    left = pairs.join(lists.select(F.col("node").alias("x"), F.struct("n", "asked", "list").alias("of_x")), "x")
    both = left.join(lists.select(F.col("node").alias("y"), F.struct("n", "asked", "list").alias("of_y")), "y")
    return both.filter(_enough("of_x", "of_y", percent)).select("x", "y")


def _placed(shared: DataFrame, groups: DataFrame | None) -> DataFrame:
    """The prefix rows with the root of the node's component so far."""
    if groups is None:
        return shared.withColumn("root", F.col("node"))
    return shared.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _stars(crowded: DataFrame, texts: DataFrame, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """Verified links (x, y) that join large groups, and the components (node, root) by them.

    Every shingle draws a lead from the component that has most of its nodes; a node of another component is paired with
    the lead it shares most such shingles with. So a round has at most one pair per node, however large a group is, and each
    link brings a node into the large component. A shingle goes on to the next round if a node was linked to its lead: one
    that unlike documents share drops out, whatever the others do."""
    links: DataFrame | None = None
    groups: DataFrame | None = None
    for i in range(ROUNDS):
        placed = _placed(crowded, groups)
        sizes = placed.groupBy("token", "root").count().groupBy("token")
        mains = sizes.agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
        placed = placed.join(mains.drop("roots"), "token")
        drawn = F.struct(F.xxhash64("node", F.lit(i)), "node", "n", "place", "asked")
        leads = placed.filter("root = main").groupBy("token").agg(F.min(drawn).alias("lead"))
        led = placed.filter("root <> main").alias("a").join(leads, "token").filter(_may_link("a", "lead", percent))
        led = cut_lineage(led.select("token", "node", F.col("lead.node").alias("lead"), _least("a", "lead", percent).alias("least")), "led")
        counted = led.groupBy("node", "lead").agg(F.count(F.lit(1)).alias("count"), F.min("least").alias("least"))
        # A lead is drawn for only part of the shingles that it shares with a node, so half of what links need will do.
        likely = counted.filter((F.col("count") > 1) & (2 * F.col("count") >= F.col("least")))
        pairs = likely.groupBy("node").agg(F.max_by("lead", F.struct("count", "lead")).alias("lead"))
        pairs = cut_lineage(pairs.select(F.col("lead").alias("x"), F.col("node").alias("y")), "tried")
        found = cut_lineage(verified(pairs, texts, percent), "links")
        links = found if links is None else links.union(found)
        if found.isEmpty():
            break
        groups = components(links.select(F.col("x").alias("a"), F.col("y").alias("b")))
        linking = led.join(found.select(F.col("x").alias("lead"), F.col("y").alias("node")), ["node", "lead"]).select("token").distinct()
        crowded = cut_lineage(crowded.join(linking, "token"), "crowded")
    return links, groups


def _joined(docs: DataFrame, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows with words and without: (id, n, node); and the nodes: (node, root, low), low being the node's first
    row as (no id, id, key)."""
    rows = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    found = cut_lineage(survey(rows), "survey")
    proven = F.assert_true(F.min("proof") == F.max("proof"), F.lit("two shingle sets of one signature"))
    row = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("key").alias("key"))
    nodes = found.filter("n > 0").groupBy("node").agg(F.min(row).alias("low"), proven.alias("proof"))
    nodes = cut_lineage(nodes.filter("proof is null").select("node", "low"), "nodes")

    # Frequent shingles are known to be shared, so their rows may lie apart; of the others one of several nodes stays.
    common = F.col("info").bitwiseAND(1) == 1
    rows_of = prefixes(rows, frequent_tokens(rows), percent).withColumn("lot", F.when(common, F.pmod("node", F.lit(LOTS))).otherwise(0))
    own = Window.partitionBy("token", "lot")
    met_others = rows_of.withColumn("low", F.min("node").over(own)).withColumn("high", F.max("node").over(own)).filter(common | (F.col("low") < F.col("high")))
    shared = met_others.select("token", "lot", "node", "info").distinct().select("token", "node", *_unpacked())
    shared = cut_lineage(shared, "prefixes")

    many = shared.groupBy("token").count().filter(F.col("count") >= CROWD).select("token")
    crowded = cut_lineage(shared.join(many, "token"), "crowded")
    in_crowd = crowded.select("node").distinct().withColumn("crowded", F.lit(True))
    wanted = shared.select("node").distinct().join(nodes, "node").join(in_crowd, "node", "left")
    wanted = wanted.select("node", F.col("low.key").alias("key"), F.coalesce("crowded", F.lit(False)).alias("crowded"))
    texts = cut_lineage(rows.select("key", "text").join(wanted, "key").select("node", "text", "crowded").dropDuplicates(["node"]), "texts")

    star_links, groups = _stars(crowded, texts.filter("crowded"), percent)
    placed = _placed(shared, groups)
    sizes = placed.groupBy("token", "root").count().groupBy("token")
    apart = sizes.agg(
        F.max_by("root", F.struct("count", "root")).alias("main"), F.count(F.lit(1)).alias("roots"), F.sum("count").alias("nodes")
    )
    placed = cut_lineage(placed.join(apart.filter("roots > 1").drop("roots"), "token"), "apart")
    pairs = cut_lineage(_candidates(placed, percent), "pairs")
    cross_links = cut_lineage(verified(pairs, texts, percent), "links")

    every = star_links.union(cross_links).select(F.col("x").alias("a"), F.col("y").alias("b"))
    roots = components(every) if groups is None or not cross_links.isEmpty() else groups
    return found, nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "low")


def row_key(id_col: str, text_col: str) -> Column:
    """A number that rows of the same id and text share."""
    return F.xxhash64(id_col, text_col)


def near_documents(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row: the size of the text's set of distinct 5-word shingles and the
    smallest id among all rows reachable by links (100 * intersection >= ``percent`` * union).

    Every link between different components of what was linked before is verified; pairs inside one component are not
    looked at again. Null, empty and blank texts: 0 shingles, linked with nothing. Rows with equal ids keep
    their rows; null ids take part, but are a component's id only where it has no other. Other columns are not
    read. Sets are compared by 64-bit hashes of their shingles; a second signature must agree for rows taken as
    equal, otherwise the job fails.
    """
    found, nodes = _joined(docs, percent, id_col, text_col)
    lowest = nodes.groupBy("root").agg(F.min("low").alias("first"))
    of_node = nodes.join(lowest, "root").select("node", F.col("first.id").alias("component"))
    linked = found.filter("n > 0").join(of_node, "node").select("id", "n", "component")
    alone = found.filter("n = 0").select("id", "n", F.col("id").alias("component"))
    return linked.union(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that stay when of each component only the row of the smallest id (of
    these the one of the smallest key of id and text) is kept. Texts without words are linked with nothing, so
    all of them stay."""
    _, nodes = _joined(docs, percent, id_col, text_col)
    keys = nodes.groupBy("root").agg(F.min("low").alias("first")).select(F.col("first.key").alias("key"))
    wordless = F.translate(F.coalesce(F.col(text_col), F.lit("")), "\t\n\x0b\x0c\r ", "") == ""
    keyed = docs.select(row_key(id_col, text_col).alias("key"), F.struct(*docs.columns).alias("row"), wordless.alias("wordless"))
    kept = keyed.filter(~F.col("wordless")).join(keys, "key", "left_semi").dropDuplicates(["key"])
    return kept.select("row.*").union(keyed.filter("wordless").select("row.*"))

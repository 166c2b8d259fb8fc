"""Near-duplicate vectors by a tiled comparison in PCA order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .components import components

THRESHOLD = 0.95
#: Distinct vectors per block; every pair of blocks is one group of work.
BLOCK_ROWS = 8192
TILE = 1024
#: Slack of the single-precision bounds; what passes is computed again in double precision.
SLACK = 1e-5


def usable(vector: Column) -> Column:
    """Not null, all components known and finite, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of components; shorter vectors are padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), dim))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by the largest component first, so that squares neither vanish nor overflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def principal_axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """Columns: eigenvectors of the mean of x xT over all unit vectors, largest share first. Each task sends its
    sum, which is as large as the dimension squared."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = unit(matrix(batch.column(0), dim))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(list(total))], ["i", "row"])

    parts = vectors.select("vector").mapInArrow(moments, "i long, row array<double>")
    sums = parts.groupBy("i").agg(F.array(*[F.sum(F.get("row", F.lit(j))) for j in range(dim)]).alias("row"))
    total = np.zeros((dim, dim))
    for r in sums.collect():
        total[r.i] = r.row
    return np.linalg.eigh((total + total.T) / 2)[1][:, ::-1]


class Ordered:
    """Unit vectors turned to the principal axes, in the order of their leading signs, with what bounds need."""

    def __init__(self, x: np.ndarray, axes: np.ndarray):
        turned = x @ axes
        dim = axes.shape[1]
        signs = np.zeros(len(x), np.int64)
        for j in range(min(12, dim)):
            signs = signs * 2 + (turned[:, j] > 0)
        self.order = np.argsort(signs, kind="stable")
        self.x, self.turned = x[self.order], turned[self.order].astype(np.float32)
        self.steps = [max(1, dim // 4), max(1, dim // 2)]
        square = np.cumsum(turned[self.order][:, ::-1] ** 2, axis=1)[:, ::-1]
        self.rest = [np.sqrt(square[:, k] if k < dim else np.zeros(len(x))).astype(np.float32) for k in self.steps]
        self.tiles = [slice(a, min(a + TILE, len(x))) for a in range(0, len(x), TILE)]
        self.center = [self.x[t].mean(0) for t in self.tiles]
        self.radius = [np.sqrt(((self.x[t] - c) ** 2).sum(1).max()) for t, c in zip(self.tiles, self.center)]


def links(a: Ordered, b: Ordered, s: int, t: int, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of tile s of a and tile t of b (places in the given order) whose cosine reaches the threshold."""
    none = np.zeros(0, np.int64)
    # Unit vectors of such a cosine are at most this far apart.
    if np.linalg.norm(a.center[s] - b.center[t]) - a.radius[s] - b.radius[t] > np.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK:
        return none, none
    at, bt = a.tiles[s], b.tiles[t]
    k = a.steps[0]
    bound = a.turned[at, :k] @ b.turned[bt, :k].T
    bound += np.outer(a.rest[0][at], b.rest[0][bt])
    i, j = np.nonzero(bound >= threshold - SLACK)
    if same and s == t:
        keep = i < j
        i, j = i[keep], j[keep]
    if len(i) > 100_000:  # many candidates: one product of the whole tile costs less than picking rows
        full = a.x[at] @ b.x[bt].T
        keep = full[i, j] >= threshold - 1e-9
        i, j = i[keep], j[keep]
    i, j = i + at.start, j + bt.start
    found = []
    for c in range(0, len(i), 50_000):
        p, q = i[c : c + 50_000], j[c : c + 50_000]
        if a.steps[1] > k:
            m = a.steps[1]
            partial = np.einsum("ij,ij->i", a.turned[p, :m], b.turned[q, :m]) + a.rest[1][p] * b.rest[1][q]
            p, q = p[partial >= threshold - SLACK], q[partial >= threshold - SLACK]
        exact = np.einsum("ij,ij->i", a.x[p], b.x[q]) >= threshold
        found.append((p[exact], q[exact]))
    if not found:
        return none, none
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give linked places the smallest label among them, in place; labels are places themselves."""
    while len(i):
        a, b = label[i], label[j]
        low = np.minimum(a, b)
        apart = a != b
        if not apart.any():
            return
        np.minimum.at(label, a[apart], low[apart])
        np.minimum.at(label, b[apart], low[apart])
        while (label[label] != label).any():
            label[:] = label[label]


def compare(nodes: np.ndarray, weights: np.ndarray, x: np.ndarray, first: np.ndarray, axes: np.ndarray, threshold: float):
    """(node, links to others by their weight, a node it is connected with) of all linked nodes. ``first``
    marks the rows of the first block; without other rows the block is compared with itself."""
    split = int(first.sum())
    sides = [np.flatnonzero(first), np.flatnonzero(~first)]
    same = split == len(first)
    a = Ordered(x[sides[0]], axes)
    b = a if same else Ordered(x[sides[1]], axes)
    place_a, place_b = sides[0][a.order], (sides[0] if same else sides[1])[b.order]
    number, label = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
    for s in range(len(a.tiles)):
        for t in range(s if same else 0, len(b.tiles)):
            i, j = links(a, b, s, t, threshold, same)
            if len(i):
                i, j = place_a[i], place_b[j]
                number += np.bincount(i, weights[j], minlength=len(nodes)).astype(np.int64)
                number += np.bincount(j, weights[i], minlength=len(nodes)).astype(np.int64)
                join_labels(label, i, j)
    linked = np.flatnonzero(number)
    return nodes[linked], number[linked], nodes[label[linked]]


def near_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row: the number of other rows of a cosine of at least
    ``threshold`` (which is above 0), the smallest id reachable by such links, and whether that is the row's own.

    Equal vectors are one node with a weight, so copies are neither compared nor listed. All pairs of blocks of
    ``block_rows`` distinct vectors are compared, tile by tile: tiles further apart than linked vectors can
    be are passed over; then leading principal dimensions are multiplied, the rest is bounded by the product
    of suffix norms, and pairs that cannot reach the threshold end there. Of a pair of blocks only counts and a
    spanning forest leave the task. The work grows with the square of the number of distinct vectors, as the
    method does; what a task holds does not grow.

    Null, empty and zero vectors and those with null or non-finite components link with nothing (0 links,
    their own id). Shorter vectors are padded with zeros. Rows with equal ids stay rows of their own;
    null ids take part, but are never a component's id unless it has no other. Other columns are not read.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    good, bad = rows.filter(usable(F.col("vector"))), rows.filter(~usable(F.col("vector")))
    distinct = good.groupBy("vector").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
    nodes = cut_lineage(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")
    size = nodes.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    blocks, dim = max(1, -(-size[0] // block_rows)), size[1]
    axes = principal_axes(nodes, dim)

    def work(table: pa.Table) -> pa.Table:
        x = unit(matrix(table.column("vector"), dim))
        found = compare(
            table.column("node").to_numpy(), table.column("n").to_numpy(), x, table.column("first").to_numpy(), axes, threshold
        )
        return pa.table(dict(zip(("node", "links", "with"), found)))

    own = nodes.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int"))
    paired = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), (F.col("block") <= F.col("other")).alias("first"),
        "node", "n", "vector",
    )
    found = cut_lineage(paired.groupBy("p", "q").applyInArrow(work, "node long, links long, with long"), "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("with").alias("b")))
    placed = nodes.select("node", "low", "n").join(counts, "node", "left").join(roots, "node", "left")
    placed = placed.withColumn("root", F.coalesce("root", "node"))
    lowest = placed.groupBy("root").agg(F.min("low").alias("component"))
    of_node = placed.join(lowest, "root").select(
        "node", "component", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links")
    )
    of_vector = nodes.select("node", "vector").join(of_node, "node").drop("node")
    linked = good.join(of_vector, "vector").select("id", "links", "component")
    alone = bad.select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    out = linked.union(alone)
    return out.select(
        F.col("id").alias(id_col), F.col("links").alias("n_links"), F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )

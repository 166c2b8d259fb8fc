"""Cost-balanced packing of token sequences."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import cut_lineage
from .units import encoder, slices, text_column

LENGTH = 2048
#: Tokens packed together in one task; the number of such groups grows with the corpus.
GROUP_TOKENS = 2_000_000


def tokenize(docs: DataFrame, vocabulary: str, end_id: int, folds: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, n_tokens, ids): every whole text's ids followed by ``end_id``, as bytes of the smallest
    width that holds the vocabulary. ``row`` tells repeated rows apart."""
    fields = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = fields.schema["id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary, folds)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text"):
                ids, edges = coder.ids(text_column(part.column("text")), end_id)
                offsets = (edges * coder.width.itemsize).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + part.num_rows)),
                        part.column("id"),
                        pa.array(np.diff(edges)),
                        pa.BinaryArray.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(ids)]),
                    ],
                    ["row", "id", "n_tokens", "ids"],
                )
                row += part.num_rows

    return fields.mapInArrow(encode, f"row long, id {id_type}, n_tokens long, ids binary")


def capacities(total: int, length: int = LENGTH) -> np.ndarray:
    """Sequences that hold exactly ``total`` tokens without padding: full ones, and for the rest one of each
    power of two in it."""
    rest = total % length
    return np.array([length] * (total // length) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1], np.int64)


def assign(sizes: np.ndarray, length: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Places of all documents: (document, start, length, sequence, offset).

    Pieces go in descending order, each to the sequence of the lowest cost so far among those with room
    for it; a piece's cost is ``linear`` per token and ``quadratic`` per pair of its tokens. Documents above
    the length give full sequences first. A piece that fits nowhere whole fills the sequence with the most
    room, and its rest takes its turn again. Ties: the earlier document, the earlier sequence.
    """
    room = capacities(int(sizes.sum()), length)
    cost = np.zeros(len(room))
    used = np.zeros(len(room), np.int64)
    queue = [(-min(int(n), length), d, 0) for d, n in enumerate(sizes) if n]
    heapq.heapify(queue)
    placed = []
    while queue:
        n, d, start = heapq.heappop(queue)
        n = -n
        s = int(np.argmin(np.where(room >= n, cost, np.inf)))
        put = n if room[s] >= n else 0
        if not put:
            s = int(np.argmax(room))
            put = int(room[s])
        placed.append((d, start, put, s, int(used[s])))
        room[s] -= put
        used[s] += put
        cost[s] += linear * put + quadratic * put * put
        left = int(sizes[d]) - start - put
        if left:
            heapq.heappush(queue, (-min(left, length), d, start + put))
    return placed


def pack(
    docs: DataFrame,
    vocabulary: str,
    end_id: int = 1,
    length: int = LENGTH,
    linear: float = 1.0,
    quadratic: float = 1.0 / LENGTH,
    group_tokens: int = GROUP_TOKENS,
    folds: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of all documents in sequences of at most ``length`` tokens (a power of two): (id, start,
    length, doc_tokens, sequence_id, offset, sequence_cost, ids), ids as little-endian unsigned 32-bit.
    ``folds``: see ``units.Encoder``; true for the default vocabulary, false is right for every one.

    The tokenized rows are written to the shared folder once. They are dealt by row, not by key, into groups of
    about ``group_tokens`` tokens, so no source, id or copied text gathers anywhere; a group is packed
    in one task, without padding (see ``capacities``). Null text: only ``end_id``. Null ids and repeated
    rows: packed row by row. Empty table: no rows. Other columns are not read.
    """
    rows = cut_lineage(tokenize(docs, vocabulary, end_id, folds, id_col, text_col), "tokens")
    total = rows.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    groups = max(1, round(total / group_tokens))
    id_type = rows.schema["id"].dataType.simpleString()
    id_arrow = to_arrow_type(rows.schema["id"].dataType)

    def fill(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("n_tokens", "descending"), ("row", "ascending")])
        sizes = table.column("n_tokens").to_numpy()
        places = assign(sizes, length, linear, quadratic)
        texts = table.column("ids").to_pylist()
        costs: dict[int, float] = {}
        for _, _, n, s, _ in places:
            costs[s] = costs.get(s, 0.0) + linear * n + quadratic * n * n
        d, start, n, s, offset = np.array(places, np.int64).reshape(-1, 5).T
        ids = []
        for k, at, size in zip(d.tolist(), start.tolist(), n.tolist()):
            width = len(texts[k]) // int(sizes[k])
            ids.append(np.frombuffer(texts[k], f"<u{width}", size, at * width).astype("<u4").tobytes())
        return pa.table(
            {
                "id": table.column("id").combine_chunks().take(pa.array(d)).cast(id_arrow),
                "start": start,
                "length": n,
                "doc_tokens": sizes[d],
                "sequence_id": (key[0].as_py() << 32) + s,
                "offset": offset,
                "sequence_cost": np.array([costs[x] for x in s.tolist()]),
                "ids": pa.array(ids, pa.binary()),
            }
        )

    dealt = rows.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    schema = f"id {id_type}, start long, length long, doc_tokens long, sequence_id long, offset long, sequence_cost double, ids binary"
    return dealt.groupBy("group").applyInArrow(fill, schema).withColumnRenamed("id", id_col)

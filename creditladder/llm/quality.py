"""Quality classifier: supervised subword embeddings, averaged per document, with a softmax output."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngrams import WordNgrams, spread
from .units import cut_units, slices, text_column

BUCKETS = 1 << 14
SIZES = (2, 3, 4)
DIM = 16
EPOCHS = 8
RATE = 0.5
#: Labelled rows that the model is fitted on (about; drawn by hash).
SAMPLE = 4000
CLASSES = 2
SAME = np.uint64(0)  # id of the word pair whose words are equal
FIRST_WORDS = 1


class Features:
    """Ids in [0, BUCKETS) of words, word pairs and character n-grams."""

    def __init__(self):
        self.ngrams = WordNgrams(SIZES, BUCKETS, letters_only=False)

    def words(self, texts: pa.StringArray):
        units, starts = cut_units(texts)
        coded = units.dictionary_encode()
        names = [w.strip() for w in coded.dictionary.to_pylist()]
        distinct = pa.array(names, pa.string()).dictionary_encode()
        codes = distinct.indices.to_numpy()[coded.indices.to_numpy()]
        blank = distinct.dictionary.to_pylist().index("") if "" in names else -1
        real = codes != blank
        starts = np.concatenate(([0], np.cumsum(real)))[starts]
        codes = codes[real]
        hashes = np.array([hash_word(w) for w in distinct.dictionary.to_pylist()], np.uint64)
        ids, sizes = self.ngrams(distinct.dictionary)
        pairs = np.zeros(len(codes), np.uint64)
        if len(codes) > 1:
            a, b = hashes[codes[:-1]], hashes[codes[1:]]
            mixed = a * np.uint64(0x9E3779B97F4A7C15) + b
            mixed ^= mixed >> np.uint64(29)
            pairs[1:] = np.where(codes[1:] == codes[:-1], SAME, np.uint64(1) + mixed % np.uint64(BUCKETS - 1))
        first = np.zeros(len(codes), bool)
        first[starts[:-1][starts[:-1] < len(codes)]] = True
        singles = np.uint64(1) + hashes % np.uint64(BUCKETS - 1)
        return codes, starts, ids, sizes, singles.astype(np.int64), pairs.astype(np.int64), first


def hash_word(word: str) -> int:
    """64-bit FNV-style hash, the same everywhere (of a word's UTF-8)."""
    import zlib

    data = word.encode("utf-8", "surrogatepass")
    return zlib.crc32(data) * 0x100000001B3 + zlib.adler32(data) & (1 << 64) - 1


@dataclass(frozen=True)
class Model:
    """A document's margin is the mean of its features' ``worth`` (embedding times the difference of the
    output weights) plus ``bias``: the softmax of two classes over the averaged embedding."""

    worth: np.ndarray
    bias: float

    def score(self, texts: pa.StringArray, features: Features) -> np.ndarray:
        codes, starts, ids, sizes, singles, pairs, first = features.words(texts)
        own = np.repeat(np.arange(len(sizes)), sizes)
        per_word = np.bincount(own, self.worth[ids], minlength=len(sizes)) + self.worth[singles]
        value = per_word[codes] + np.where(first, 0.0, self.worth[pairs])
        number = sizes[codes] + 2 - first
        total = np.concatenate(([0.0], np.cumsum(value)))[starts]
        count = np.concatenate(([0], np.cumsum(number)))[starts]
        mean = np.diff(total) / np.maximum(np.diff(count), 1)
        return 1 / (1 + np.exp(-np.clip(mean + self.bias, -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> Model:
    """Stochastic gradient descent, one document a step, over (feature ids, their shares, class) rows."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    out, bias = np.zeros((CLASSES, DIM)), np.zeros(CLASSES)
    steps, done = EPOCHS * max(1, len(rows)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            ids, share, label = rows[i]
            rate = RATE * (1 - done / steps)
            done += 1
            mean = share @ vectors[ids] if len(ids) else np.zeros(DIM)
            logits = out @ mean + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            back = p @ out
            out -= rate * np.outer(p, mean)
            bias -= 0.1 * rate * p
            if len(ids):
                # A mean spreads the gradient over all features; scaled up so that long texts learn too.
                vectors[ids] -= (rate * np.sqrt(len(ids)) * share)[:, None] * back
    return Model(vectors @ (out[1] - out[0]), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """The model from ``labels`` (id, 0 or 1) of texts in ``docs``.

    About ``sample`` labelled ids are drawn by hash before the join, so the join, the driver's share (ids and
    counts of at most BUCKETS features a text) and the training are bounded. Null labels, labels other than
    0 and 1 and null texts are left out; with no labelled text the score is 0.5 everywhere.
    """
    marked = labels.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    n = marked.count()
    draw = F.shiftrightunsigned(F.xxhash64("id", F.lit(11)), 11) < F.lit(int(min(1.0, sample / max(n, 1)) * (1 << 53)))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(draw & F.col("text").isNotNull())
    rows = texts.join(marked.filter(draw), "id").select("id", "text", "label")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            for part in slices(batch, "text"):
                codes, starts, ids, sizes, singles, pairs, first = features.words(text_column(part.column("text")))
                out = []
                for a, b in zip(starts, starts[1:]):
                    own = codes[a:b]
                    all_ids = np.concatenate((spread(own, ids, sizes)[0], singles[own], pairs[a:b][~first[a:b]])) if b > a else ids[:0]
                    used, number = np.unique(all_ids, return_counts=True)
                    out.append((used.astype("<i4").tobytes(), (number / max(1, number.sum())).astype("<f4").tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("label"), pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary())],
                    ["id", "label", "ids", "share"],
                )

    id_type = rows.schema["id"].dataType.simpleString()
    got = rows.mapInArrow(extract, f"id {id_type}, label int, ids binary, share binary").collect()
    got.sort(key=lambda r: (r.id, r.label, r.ids))
    return train([(np.frombuffer(r.ids, "<i4"), np.frombuffer(r.share, "<f4").astype(float), r.label) for r in got])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text: the probability of class 1. Null and empty texts have no feature and
    get the bias alone; null ids and repeated rows stay rows of their own; other columns are not read."""
    fields = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = fields.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, features = shared.value, Features()
        for batch in batches:
            for part in slices(batch, "text"):
                values = own.score(text_column(part.column("text")), features)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(values)], ["id", "score"])

    return fields.mapInArrow(apply, f"id {id_type}, score double").withColumnRenamed("id", id_col)

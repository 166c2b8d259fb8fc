"""Language identification by the nearest of several centroids per language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ngrams import WordNgrams, spread
from .units import cut_units, folded, give_back, slices, text_column, tidy

BUCKETS = 4096
SIZES = (1, 2, 3)
CENTROIDS = 4
#: Labelled rows per language that the centroids are fitted on (about; drawn by hash). Document frequencies
#: come from all labelled rows.
SAMPLE = 1000
#: A text is rejected when its cosine falls below this share of the lowest one among labelled texts of its size.
REJECT_SHARE = 0.5
#: Below this many n-grams (as a power of two) a text says too little to be rejected for its distance.
REJECT_FROM = 6
UNKNOWN = "und"
SIZE_CLASSES = 24
DOCS_AT_ONCE = 256
#: Bytes of text whose words are looked at together: what a task holds beside a batch grows with it.
SLICE = 2 << 20


class Vectors:
    """Raw n-gram counts of texts."""

    def __init__(self):
        self.ngrams = WordNgrams(SIZES, BUCKETS, letters_only=True)

    def __call__(self, texts: pa.StringArray) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the first text, counts of some texts as rows), in order."""
        units, starts = cut_units(folded(texts), marks=True)
        coded = units.dictionary_encode()
        codes = coded.indices.to_numpy()
        ids, sizes = self.ngrams(coded.dictionary)
        for a in range(0, len(texts), DOCS_AT_ONCE):
            b = min(a + DOCS_AT_ONCE, len(texts))
            own = codes[starts[a] : starts[b]]
            grams, n = spread(own, ids, sizes)
            doc = np.repeat(np.repeat(np.arange(b - a), np.diff(starts[a : b + 1])), n)
            counts = np.bincount(doc * BUCKETS + grams, minlength=(b - a) * BUCKETS)
            yield a, counts.reshape(b - a, BUCKETS)


@dataclass(frozen=True)
class Centroids:
    languages: list[str]
    language: np.ndarray  # of each centroid
    centers: np.ndarray
    idf: np.ndarray
    least: np.ndarray  # by size class

    def weigh(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit TF-IDF vectors and the size class of each text."""
        x = counts * self.idf
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        x /= np.where(norm > 0, norm, 1)[:, None]
        return x, size_class(counts.sum(1))

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, cosine, rejected) of each text; ties go to the earlier centroid."""
        x, size = self.weigh(counts)
        cosines = x @ self.centers.T
        best = cosines.argmax(1)
        cosine = np.clip(cosines[np.arange(len(x)), best], 0, 1)
        return self.language[best], cosine, cosine < self.least[size]


def size_class(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(n, 1)).astype(int), SIZE_CLASSES - 1)


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from spread-out starts; at most k unit centers, none empty."""
    centers = x[:1]
    while len(centers) < min(k, len(x)):
        centers = np.vstack((centers, x[(x @ centers.T).max(1).argmin()]))
    for _ in range(rounds):
        own = (x @ centers.T).argmax(1)
        sums = np.array([x[own == c].sum(0) for c in np.unique(own)])
        norms = np.linalg.norm(sums, axis=1)
        centers = sums[norms > 0] / norms[norms > 0, None]
    return centers


def fit(labelled: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Centroids:
    """Centroids from rows with a text and a language.

    Document frequencies and the number of rows per language cover all of them; frequencies are added up in the cluster, and
    one number per n-gram bucket comes back. About ``sample`` rows per language, drawn by a hash of id and text, are
    clustered on the driver; so their number (and the size of what is sent there, at most a count per bucket and row)
    is bounded per language, whatever the corpus holds. The driver keeps them sparse and has the vectors of one language at a
    time. What the pass over the texts yields is stored in the shared folder.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, F.length(text_col)).alias("h")
    )
    per_language = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(per_language)
    share = {lang: min(1.0, sample / n) for lang, n in per_language.items()}
    number, names = pa.list_(pa.int32()), ["lang", "buckets", "counts"]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors()
        frequency = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                langs = part.column("lang").to_pylist()
                draw = (part.column("h").to_numpy().view(np.uint64) >> np.uint64(11)) / float(1 << 53)
                for a, counts in vectors(text_column(part.column("text"))):
                    frequency += (counts > 0).sum(0)
                    kept = [i for i in range(len(counts)) if draw[a + i] < share[langs[a + i]]]
                    if kept:
                        at = [np.flatnonzero(counts[i]) for i in kept]
                        arrays = [pa.array(at, number), pa.array([counts[i][x] for i, x in zip(kept, at)], number)]
                        yield pa.RecordBatch.from_arrays([pa.array([langs[a + i] for i in kept], pa.string()), *arrays], names)
        at = np.flatnonzero(frequency)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([at], number), pa.array([frequency[at]], number)], names)

    drawn = cut_lineage(rows.mapInArrow(tidy(features), "lang string, buckets array<int>, counts array<int>"), "language_sample")
    pairs = drawn.filter("lang is null").select(F.explode(F.arrays_zip("buckets", "counts")).alias("x"))
    frequency = np.zeros(BUCKETS)
    for r in pairs.groupBy("x.buckets").agg(F.sum("x.counts").alias("n")).collect():
        frequency[r.buckets] = r.n
    idf = np.log((1 + sum(per_language.values())) / (1 + frequency))
    model = Centroids(languages, np.zeros(0, int), np.zeros((0, BUCKETS)), idf, np.zeros(SIZE_CLASSES))
    taken = drawn.filter("lang is not null").toArrow()
    centers, owners = [], []
    for number, lang in enumerate(languages):
        x, _ = model.weigh(_rows(taken, lang))
        if len(x):
            filled = x.any(1)
            own = cluster(x if filled.all() else x[filled], CENTROIDS) if filled.any() else x[:0]
            centers.append(own)
            owners += [number] * len(own)
        del x
    least = np.full(SIZE_CLASSES, np.inf)
    stacked = np.vstack(centers) if centers else model.centers
    for lang in languages if len(stacked) else []:
        x, size = model.weigh(_rows(taken, lang))
        np.minimum.at(least, size, (x @ stacked.T).max(1))
        del x
    del taken
    give_back()
    # A size class without labelled texts takes the next smaller class's bound.
    for i in range(SIZE_CLASSES):
        least[i] = least[i] if np.isfinite(least[i]) else (least[i - 1] if i else 0.0)
    least[:REJECT_FROM] = 0
    return Centroids(languages, np.array(owners, int), stacked, idf, REJECT_SHARE * least)


def _rows(taken: pa.Table, lang: str) -> np.ndarray:
    """The counts of a language's texts as rows, in an order that does not depend on theirs."""
    own = taken.filter(pc.equal(taken.column("lang"), lang))
    out = np.zeros((len(own), BUCKETS), np.int32)
    at = 0
    for batch in own.to_batches():
        buckets, counts = batch.column("buckets"), batch.column("counts")
        row = at + np.repeat(np.arange(len(batch)), pc.list_value_length(buckets).to_numpy())
        out[row, buckets.flatten().to_numpy()] = counts.flatten().to_numpy()
        at += len(batch)
    return out[sorted(range(len(out)), key=lambda i: out[i].astype("<i4").tobytes())]


def predict(docs: DataFrame, model: Centroids, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) of every whole text.

    ``score`` is the cosine to the nearest centroid. Rejected: null texts, texts without a letter (both
    ``und``, score 0) and texts further from every centroid than labelled texts of their size. Without any
    centroid everything is ``und`` and rejected. Null ids and repeated rows stay rows of their own; other
    columns are not read. No shuffle.
    """
    fields = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = fields.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, vectors = shared.value, Vectors()
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                pred, cosine, rejected = _predict(text_column(part.column("text")), own, vectors)
                yield pa.RecordBatch.from_arrays([part.column("id"), pred, cosine, rejected], ["id", "lang_pred", "score", "rejected"])

    return fields.mapInArrow(tidy(score), f"id {id_type}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)


def _predict(texts: pa.StringArray, model: Centroids, vectors: Vectors) -> tuple[pa.Array, pa.Array, pa.Array]:
    n = len(texts)
    lettered = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
    language, cosine, far = np.zeros(n, int), np.zeros(n), np.ones(n, bool)
    if len(model.centers):
        for a, counts in vectors(texts):
            b = a + len(counts)
            language[a:b], cosine[a:b], far[a:b] = model.nearest(counts)
    known = lettered & (len(model.centers) > 0)
    names = np.array([*model.languages, UNKNOWN], object)
    return (
        pa.array(names[np.where(known, language, len(model.languages))], pa.string()),
        pa.array(np.where(known, cosine, 0.0)),
        pa.array(far | ~known),
    )


def keep_identified(docs: DataFrame, model: Centroids, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that are not rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, vectors = shared.value, Vectors()
        for batch in batches:
            for part in slices(batch, text_col, SLICE):
                rejected = _predict(text_column(part.column(text_col)), own, vectors)[2]
                yield part.filter(pc.invert(rejected))

    return docs.mapInArrow(tidy(select), docs.schema)

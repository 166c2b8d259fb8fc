"""Licence scans by a positional index of rare words.

A passage of a licence is indexed by its words and their places. For each file and passage the file's rarest words of that
passage (by document frequency over the whole corpus) are looked up; each occurrence proposes a place where the
passage would begin, and the proposals of different words are intersected. Where enough of them agree, up to a drift
for words left out or put in, the passage's key phrases are verified word for word. Base phrases are passages
that must agree in all words without drift.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import BASE, PASSAGES, Passage

#: Words looked up per file and passage, the share of them that must agree, and words by which they may drift.
RARE = 6
AGREE = 2 / 3
DRIFT = 4

#: Bytes of words: digits, ASCII letters, capitals folded, and everything outside ASCII; others become blanks.
WORD_BYTES = bytes(
    b | 0x20 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Template:
    """One passage with its postings (word: places) and its key phrases with their places. ``exact``: a base phrase."""

    def __init__(self, passage: Passage, exact: bool):
        self.label, self.exact = passage.label, exact
        self.words = words_of(passage.text.encode())
        self.postings: dict[bytes, list[int]] = {}
        for i, w in enumerate(self.words):
            self.postings.setdefault(w, []).append(i)
        self.phrases = []
        for phrase in passage.phrases:
            p = words_of(phrase.encode())
            at = next((i for i in range(len(self.words)) if self.words[i : i + len(p)] == p), None)
            if at is None:
                raise ValueError(f"{passage.label}: {phrase!r} is not in its passage")
            self.phrases.append((p, at))
        self.needed = {w for p, _ in self.phrases for w in p}
        self.drift = 0 if exact else DRIFT

    def rarest(self, present: set[bytes], weights: dict[bytes, float]) -> list[bytes]:
        mine = sorted((w for w in self.postings if w in present), key=lambda w: (-weights[w], w))
        return mine[:RARE]


def agreed(places: list[list[int]], drift: int, least: int) -> Iterator[range]:
    """The offsets that at least ``least`` of the words propose, each up to ``drift`` words off, as ranges."""
    events: list[tuple[int, int]] = []
    for own in places:
        low = high = None
        for o in sorted(own):
            if low is not None and o - drift <= high:
                high = o + drift + 1
                continue
            if low is not None:
                events += [(low, 1), (high, -1)]
            low, high = o - drift, o + drift + 1
        if low is not None:
            events += [(low, 1), (high, -1)]
    events.sort()
    level, since = 0, 0
    for at, step in events:
        if level >= least and at > since:
            yield range(since, at)
        level, since = level + step, at


class Index:
    """All passages, and the weights (IDF) of their words."""

    def __init__(self, base: Sequence[Passage], passages: Sequence[Passage], docs: int = 0, found: dict[bytes, int] | None = None):
        self.templates = [Template(p, True) for p in base] + [Template(p, False) for p in passages]
        self.vocabulary = {w for t in self.templates for w in t.words}
        found = found or {}
        self.weights = {w: math.log((docs + 1) / (found.get(w, 0) + 1)) for w in self.vocabulary}

    def hits(self, words: list[bytes]) -> list[tuple[str, int, int, float, bool]]:
        """(label, start, end, score, base) of every passage in the words, ``start`` and ``end`` spanning the key phrases. The
        score is the share of the passage's words (by weight) that stand at their places, up to the drift."""
        present = self.vocabulary.intersection(words)
        possible = [t for t in self.templates if t.needed <= present]
        if not possible:
            return []
        wanted = {w for t in possible for w in t.postings}
        places: dict[bytes, list[int]] = {}
        for i, w in enumerate(words):
            if w in wanted:
                places.setdefault(w, []).append(i)
        out = []
        for t in possible:
            rare = t.rarest(present, self.weights)
            proposed = [[i - k for i in places[w] for k in t.postings[w]] for w in rare]
            least = len(rare) if t.exact else math.ceil(AGREE * len(rare))
            for offsets in agreed(proposed, t.drift, least):
                for o in offsets:
                    spans = self._phrases(t, words, o)
                    if spans:
                        score = 1.0 if t.exact else self._score(t, places, o)
                        out.append((t.label, min(s for s, _ in spans), max(e for _, e in spans), score, t.exact))
        return sorted(out)

    def _phrases(self, t: Template, words: list[bytes], offset: int) -> list[tuple[int, int]]:
        """The places of all key phrases, the first exactly at its place; none unless all are there."""
        spans = []
        for k, (phrase, at) in enumerate(t.phrases):
            slack = t.drift if k else 0
            tried = sorted(range(offset + at - slack, offset + at + slack + 1), key=lambda p: abs(p - offset - at))
            found = next((p for p in tried if p >= 0 and words[p : p + len(phrase)] == phrase), None)
            if found is None:
                return []
            spans.append((found, found + len(phrase)))
        return spans

    def _score(self, t: Template, places: dict[bytes, list[int]], offset: int) -> float:
        there = whole = 0.0
        for w, own in t.postings.items():
            # A word that every row holds still counts a little, so that no passage is without weight.
            weight = self.weights[w] + 1e-3
            near = {k for k in own for i in places.get(w, []) if abs(i - k - offset) <= t.drift}
            there += weight * len(near)
            whole += weight * len(own)
        return there / whole


def document_frequencies(rows: DataFrame, vocabulary: set[bytes]) -> tuple[int, dict[bytes, int]]:
    """The number of rows (column text), and how many hold each word of the vocabulary: at most one row per word."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            for text in batch.column("text").cast(pa.binary()):
                found.update(vocabulary.intersection(words_of(text.as_py() or b"")))
        words = pa.array([None, *found], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([words, pa.array([rows, *found.values()], pa.int64())], ["word", "n"])

    counted = rows.select("text").mapInArrow(scan, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r.word: r.n for r in counted.collect()}
    return found.pop(None, 0), {w.encode(): n for w, n in found.items()}


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: Sequence[Passage] = BASE, passages: Sequence[Passage] = PASSAGES
) -> DataFrame:
    """(id, n_words, hits) of every whole text: ``hits`` as structs (label, start, end, score, base) of word places, by label,
    then start; ``base`` marks the base phrases, of which all places are found, overlapping ones too.

    Words are runs of digits, ASCII letters (capitals folded) and characters outside ASCII. A passage is found where its
    first key phrase stands, the others up to DRIFT words off their places from there, and at least AGREE of the RARE
    rarest words of the passage that the file has likewise. Ties of rarity go to the smaller word. Null, empty and blank
    texts: 0 words, no hits. Null ids and repeated rows stay as rows of their own (and count each in the frequencies);
    an empty table gives no rows; other columns are not read, so their names cannot clash.

    Two passes over the texts, no shuffle but of the frequencies, one row per word of the passages. A text is worked on by
    one task, in time in proportion to its words.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    index = Index(base, passages, *document_frequencies(rows, Index(base, passages).vocabulary))
    shared = docs.sparkSession.sparkContext.broadcast(index)
    hit = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            counts, found = [], []
            for text in batch.column("text").cast(pa.binary()):
                words = words_of(text.as_py() or b"")
                counts.append(len(words))
                found.append([dict(zip(("label", "start", "end", "score", "base"), h)) for h in index.hits(words)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(counts, pa.int64()), pa.array(found, pa.list_(hit))], ["id", "n_words", "hits"]
            )

    out = rows.mapInArrow(scan, f"id {id_type}, n_words long, hits array<struct<label:string,start:long,end:long,score:double,base:boolean>>")
    return out.withColumnRenamed("id", id_col)

"""Texts as Arrow arrays cut into units at safe boundaries, and tokenizer results kept per distinct unit.

A unit starts at a blank or line feed that follows a character that is not white space, or at the start of
a text. No pre-tokenizer of the supplied vocabularies joins characters across such a place, and none of
their special strings holds white space, so a text's ids are the ids of its units in order. Words repeat,
so each distinct unit of a batch is looked up once and encoded only where it is not kept yet.
"""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 8 << 20
ENCODE_BYTES = 64 << 10
#: A worker keeps the results of at most this many units, none of them longer than so many characters.
KEPT_UNITS = 200_000
KEPT_LENGTH = 64


def tidy(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``fn``, and at a task's end what its worker holds unused goes back to the system: workers live on between tasks, and
    otherwise each stage's largest need stays with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    """What this process holds unused goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_column(column: pa.Array) -> pa.StringArray:
    """The column without nulls (empty instead), with its own 32-bit offsets from 0."""
    column = pc.fill_null(column.cast(pa.string()), "")
    return pa.concat_arrays([column]) if column.offset == 0 else pa.array(column.to_pylist(), pa.string())


def byte_view(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than texts) and the bytes they point into."""
    _, offsets, data = texts.buffers()
    edges = np.frombuffer(offsets, np.int32, len(texts) + 1) if len(texts) else np.zeros(1, np.int32)
    return edges, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` bytes of text; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    run = (np.cumsum(sizes, dtype=np.int64) - sizes) // most
    starts = [*np.flatnonzero(np.diff(run, prepend=-1)), batch.num_rows]
    for a, b in zip(starts, starts[1:]):
        yield batch.slice(a, b - a)


def folded(texts: pa.StringArray) -> pa.StringArray:
    """ASCII capitals as small letters and line feeds as blanks, for vocabularies that fold both anyway, so
    that fewer distinct units remain. Capitals before a character outside ASCII stay, since only some small
    letters combine with a mark, and so does everything when a special string may be in the texts."""
    edges, data = byte_view(texts)
    if pc.any(pc.match_substring(texts, "<|")).as_py():
        return texts
    plain = np.append(data[1:] < 0x80, True) if len(data) else np.zeros(0, bool)
    data = np.where((data >= 0x41) & (data <= 0x5A) & plain, data + 0x20, np.where(data == 0x0A, 0x20, data)).astype(np.uint8)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(edges), pa.py_buffer(data))


#: ASCII characters that, after an ASCII letter, begin a new unit where a vocabulary splits words from marks.
#: Not among them: "|", which stands inside special strings.
MARKS = np.isin(np.arange(256), np.frombuffer(b"!\"#$%&()*+,-./:;=?@[]^_`{}~'", np.uint8))
LETTERS = np.isin(np.arange(256), np.arange(256)[65:91].tolist() + list(range(97, 123)))


def cut_units(texts: pa.StringArray, marks: bool = False) -> tuple[pa.StringArray, np.ndarray]:
    """The units of all texts, and for each text (and the end) the number of units before it. ``marks``: cut
    also between an ASCII letter and a mark, for pre-tokenizers that never join the two."""
    edges, data = byte_view(texts)
    cut = np.zeros(int(edges[-1]) + 1, bool)
    at = np.flatnonzero((data[1 : edges[-1]] == 0x20) | (data[1 : edges[-1]] == 0x0A)) + 1
    before = data[at - 1]
    safe = (before > 0x20) & (before < 0x7F)
    wide = np.flatnonzero(before >= 0x80)
    if len(wide):
        last, middle, lead = before[wide], data[at[wide] - 2], data[np.maximum(at[wide] - 3, 0)]
        # UTF-8 of white space outside ASCII (U+0085, U+00A0; U+1680, U+2000 to U+205F, U+3000).
        two = (middle == 0xC2) & ((last == 0x85) | (last == 0xA0))
        three = (lead >= 0xE1) & (lead <= 0xE3) & ((middle == 0x80) | (middle == 0x81) | (middle == 0x9A))
        safe[wide] = ~(two | three)
    cut[at[safe]] = True
    if marks:
        cut[1 : edges[-1]] |= MARKS[data[1 : edges[-1]]] & LETTERS[data[: max(edges[-1] - 1, 0)]]
    cut[edges] = True
    cuts = np.flatnonzero(cut).astype(np.int32)
    starts = np.searchsorted(cuts, edges)
    units = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), texts.buffers()[2] or pa.py_buffer(b""))
    return units, starts


def balanced(values: list[str], most: int = ENCODE_BYTES) -> Iterator[list[str]]:
    """The values in batches of about equal bytes; a longer value is a batch of its own."""
    batch, size = [], 0
    for value in values:
        n = 4 * len(value) if len(value) > most // 4 else len(value.encode("utf-8", "surrogatepass"))
        if batch and size + n > most:
            yield batch
            batch, size = [], 0
        batch.append(value)
        size += n
    if batch:
        yield batch


@lru_cache(maxsize=2)
def encoder(path: str, folds: bool = False) -> Encoder:
    """The encoder of a worker process, which later tasks find with its units."""
    return Encoder(path, folds)


class Encoder:
    """A tokenizer of the ``tokenizers`` library whose results for distinct units are kept between batches.
    ``KEPT_UNITS`` and ``KEPT_LENGTH`` bound the memory: units beyond either are encoded once in each batch
    that holds them.
    ``folds``: the vocabulary lower-cases, drops white space and splits letters from marks."""

    def __init__(self, path: str, folds: bool = False, kept: int = KEPT_UNITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = np.dtype(np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self.folds, self.kept = folds, kept
        self.known_lengths: dict[str, int] = {}
        self.known_ids: dict[str, bytes] = {}

    def _units(self, texts: pa.StringArray):
        units, starts = cut_units(folded(texts), marks=True) if self.folds else cut_units(texts)
        coded = units.dictionary_encode()
        return coded.dictionary.to_pylist(), coded.indices.to_numpy(), starts

    def _look_up(self, words: list[str], result, known: dict) -> list:
        found = [known.get(w) for w in words]
        new = [i for i, x in enumerate(found) if x is None]
        at = iter(new)
        for batch in balanced([words[i] for i in new]):
            for word, encoding in zip(batch, self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)):
                found[next(at)] = value = result(encoding)
                if len(known) < self.kept and len(word) <= KEPT_LENGTH:
                    known[word] = value
        return found

    def lengths(self, texts: pa.StringArray) -> np.ndarray:
        """Number of ids of each text."""
        words, codes, starts = self._units(texts)
        sizes = np.array(self._look_up(words, len, self.known_lengths), np.int64)
        total = np.concatenate(([0], np.cumsum(sizes[codes] if len(codes) else sizes[:0])))
        return np.diff(total[starts])

    def ids(self, texts: pa.StringArray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, each text followed by ``end``; and each text's place there."""
        words, codes, starts = self._units(texts)
        parts = self._look_up(words, lambda e: np.array(e.ids, self.width).tobytes(), self.known_ids)
        flat = np.frombuffer(b"".join(parts), self.width)
        sizes = np.array([len(p) for p in parts], np.int64) // self.width.itemsize
        firsts = np.cumsum(sizes) - sizes
        n = sizes[codes] if len(codes) else sizes[:0]
        done = np.concatenate(([0], np.cumsum(n)))
        stream = flat[np.repeat(firsts[codes] - done[:-1], n) + np.arange(done[-1])] if len(codes) else flat[:0]
        edges = done[starts]
        lengths = np.diff(edges)
        out = np.full(len(stream) + len(texts), end, self.width)
        out[np.arange(len(stream)) + np.repeat(np.arange(len(texts)), lengths)] = stream
        return out, edges + np.arange(len(texts) + 1)

"""Periodic runs of words, found in a grammar of each text.

A run is a maximal stretch of words with smallest period q (words q apart are identical) of at least
max(LEAST, TIMES * q) words. The steps, text by text:

1. Words become numbers. A word of a run always lies in a window of WINDOW words that occurs again in the text, so only
   stretches of such windows go on; the rest cannot hold a run.
2. Re-Pair: the most frequent pair of neighbours becomes a nonterminal, until no pair occurs twice. Pairs of equal
   frequency go in the order in which they arose, which keeps the rules of a repeated passage balanced.
3. Every nonterminal is looked at once: the runs that cross the boundary between its two halves. Such a run has two
   periods on one side, so its period is that of a square at the boundary; squares are found by prefix hashes,
   the shortest first, and compared word by word. What is left of a stretch after Re-Pair is paired off level by level
   and treated in the same way.
4. Runs of a nonterminal are carried to all places of its derivations, and those of one period that overlap by
   a period or more are merged, which leaves the maximal ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import PRIME, mix
from .units import slices

#: A run has at least LEAST words and TIMES periods. The windows of step 1 hold for these two values.
LEAST = 6
TIMES = 4
WINDOW = 5
SLICE = 4 << 20

Run = tuple[int, int, int]  # start, length, period


def recurring(ids: np.ndarray) -> np.ndarray:
    """Which words lie in a window that occurs again. Windows are compared by hash, so a few more may be marked."""
    marked = np.zeros(len(ids), bool)
    n = len(ids) - WINDOW + 1
    if n < 2:
        return marked
    words = mix(ids.astype(np.uint64) + np.uint64(1))
    windows = words[:n].copy()
    for i in range(1, WINDOW):
        windows = windows * np.uint64(PRIME) + words[i : n + i]
    order = np.argsort(windows)
    again = np.flatnonzero(windows[order[1:]] == windows[order[:-1]])
    for i in range(WINDOW):
        marked[order[again] + i] = True
        marked[order[again + 1] + i] = True
    return marked


def re_pair(symbols: list[int], first: int) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """The rules of new symbols (numbered from ``first``), a place where each begins, and the places of ``symbols``
    that are left, which is changed in place. Negative symbols are never paired."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    symbols.append(-1)
    places: dict[tuple[int, int], list[int]] = {}
    for i in range(n - 1):
        if symbols[i] >= 0 and symbols[i + 1] >= 0:
            places.setdefault((symbols[i], symbols[i + 1]), []).append(i)
    heap = [(-len(at), k, pair) for k, (pair, at) in enumerate(places.items()) if len(at) > 1]
    made = len(places)
    heapify(heap)
    rules, begins = [], []
    while heap:
        count, age, pair = heappop(heap)
        a, b = pair
        there = [i for i in places[pair] if symbols[i] == a and symbols[after[i]] == b]
        apart, second = [], -1
        for i in there:
            if i != second:
                apart.append(i)
                second = after[i]
        if len(apart) < -count:
            places[pair] = there
            if len(apart) > 1:
                heappush(heap, (-len(apart), age, pair))
            continue
        del places[pair]
        new = first + len(rules)
        rules.append(pair)
        begins.append(apart[0])
        for i in apart:
            gone = after[i]
            symbols[i], symbols[gone] = new, -2
            after[i] = after[gone]
            if after[i] < n:
                before[after[i]] = i
        born: dict[tuple[int, int], list[int]] = {}
        for i in apart:
            left, right = before[i], after[i]
            if left >= 0 and 0 <= symbols[left] != new:
                born.setdefault((symbols[left], new), []).append(left)
            if right < n and symbols[right] >= 0:
                born.setdefault((new, symbols[right]), []).append(i)
        for pair, at in born.items():
            places[pair] = at
            if len(at) > 1:
                heappush(heap, (-len(at), made, pair))
                made += 1
    symbols.pop()
    return rules, begins, [i for i in range(n) if symbols[i] != -2]


class Squares:
    """Squares and periods in one sequence of numbers. Hashes only propose; words decide."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        self.powers = np.full(len(ids) + 1, PRIME, np.uint64)
        self.powers[0] = 1
        self.powers = np.cumprod(self.powers)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(ids.astype(np.uint64) + np.uint64(1)) * self.powers[:-1])))

    def _after(self, m: int, e: int) -> np.ndarray:
        most = (e - m) // 2
        s, one = self.sums, self.sums[m + 1 : m + most + 1]
        return np.flatnonzero((one - s[m]) * self.powers[1 : most + 1] == s[m + 2 : m + 2 * most + 1 : 2] - one) + 1

    def _before(self, s: int, m: int) -> np.ndarray:
        most = (m - s) // 2
        q = np.arange(1, most + 1)
        one = self.sums[m - q]
        return np.flatnonzero((one - self.sums[m - 2 * q]) * self.powers[q] == self.sums[m] - one) + 1

    def _widest(self, s: int, e: int, q: int, at: int) -> tuple[int, int]:
        """The widest part of [s, e) around ``at`` in which words q apart are equal."""
        unlike = np.flatnonzero(self.ids[s : e - q] != self.ids[s + q : e]) + s
        k = np.searchsorted(unlike, at)
        return (int(unlike[k - 1]) + 1 if k else s), (int(unlike[k]) + q if k < len(unlike) else e)

    def crossing(self, s: int, m: int, e: int) -> set[Run]:
        """The runs of [s, e) alone that hold both word m - 1 and word m, as (start - s, length, period)."""
        found = set()
        for squares, right in ((self._after(m, e), True), (self._before(s, m), False)):
            while len(squares):
                q = int(squares[0])
                low, high = self._widest(s, e, q, m if right else m - 2 * q)
                reach = high - m if right else m - low
                if (high >= m + 2 * q if right else low <= m - 2 * q and high >= m):
                    if low < m < high and high - low >= max(LEAST, TIMES * q):
                        found.add((low - s, high - low, q))
                    # Longer squares inside this one's reach are repetitions of it.
                    squares = squares[2 * squares > reach]
                else:
                    squares = squares[1:]
        return found


def _merged(found: list[Run]) -> list[Run]:
    out: list[Run] = []
    period, start, end = 0, 0, 0
    for q, at, length in sorted((q, at, length) for at, length, q in found):
        if q == period and at + q <= end:
            end = max(end, at + length)
            continue
        if period:
            out.append((start, end - start, period))
        period, start, end = q, at, at + length
    if period:
        out.append((start, end - start, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def runs(ids: np.ndarray) -> list[Run]:
    """All runs of a sequence of word numbers, by start, then period."""
    kept = np.flatnonzero(recurring(ids))
    if len(kept) < LEAST:
        return []
    breaks = np.flatnonzero(np.diff(kept) > 1) + 1
    origin = np.insert(kept, breaks, -1)
    body = np.insert(ids[kept], breaks, -1)
    symbols, first = body.tolist(), int(ids.max()) + 1
    rules, begins, left = re_pair(symbols, first)

    sizes: list[int] = []
    for a, b in rules:
        sizes.append(sum(sizes[x - first] if x >= first else 1 for x in (a, b)))
    squares = Squares(body)
    own: list[set[Run]] = []
    useful: list[bool] = []
    for (a, b), at, size in zip(rules, begins, sizes):
        half = sizes[a - first] if a >= first else 1
        own.append(squares.crossing(at, at + half, at + size) if size >= LEAST else set())
        useful.append(bool(own[-1]) or any(x >= first and useful[x - first] for x in (a, b)))

    found: list[Run] = []
    derived: list[list[int]] = [[] for _ in rules]
    ends = {}
    for i in left:
        if symbols[i] >= first:
            derived[symbols[i] - first].append(i)
            ends[i] = i + sizes[symbols[i] - first]
        else:
            ends[i] = i + 1
    level: list[tuple[int, int]] = [(i, ends[i]) for i in left]
    while len(level) > 1:
        above = []
        k = 0
        while k < len(level):
            s, m = level[k]
            if k + 1 < len(level) and body[s] >= 0 and body[m] >= 0:
                e = level[k + 1][1]
                if e - s >= LEAST:
                    found += [(s + at, length, q) for at, length, q in squares.crossing(s, m, e)]
                above.append((s, e))
                k += 2
            else:
                above.append((s, m))
                k += 1
        if len(above) == len(level):
            break
        level = above
    for k in range(len(rules) - 1, -1, -1):
        if useful[k]:
            a, b = rules[k]
            half = sizes[a - first] if a >= first else 1
            found += [(p + at, length, q) for p in derived[k] for at, length, q in own[k]]
            if a >= first:
                derived[a - first] += derived[k]
            if b >= first:
                derived[b - first] += [p + half for p in derived[k]]
        derived[k] = []
    return [(int(origin[at]), length, q) for at, length, q in _merged(found)]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed) of every whole text: ``runs`` as structs (start, length, period) by start, then
    period, words numbered from 0; ``collapsed`` the words that stay when each run keeps its first period only
    (a word goes if it lies in any run after that run's first period), joined by one blank.

    Words are runs of characters other than ASCII white space, compared as they are. Null, empty and blank texts: 0
    words, no runs, an empty text. Null ids and repeated rows stay as rows of their own; other columns are not read, so
    their names cannot clash. No shuffle. A text is worked on by one task, in time in proportion to its words (times
    a logarithm) and about 300 bytes a word; texts go through in slices of a few MB.
    """
    fields = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = fields.schema["id"].dataType.simpleString()
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                counts, every, collapsed = [], [], []
                for text in part.column("text").cast(pa.binary()).to_pylist():
                    words = (text or b"").split()
                    numbers: dict[bytes, int] = {}
                    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
                    found = runs(ids) if len(numbers) < len(words) else []
                    if found:
                        stays = np.ones(len(words), bool)
                        for start, length, period in found:
                            stays[start + period : start + length] = False
                        words = [w for w, stay in zip(words, stays.tolist()) if stay]
                    counts.append(len(ids))
                    every.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                    collapsed.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(counts, pa.int64()), pa.array(every, pa.list_(run_type)), pa.array(collapsed, pa.binary()).cast(pa.string())],
                    ["id", "n_words", "runs", "collapsed"],
                )

    out = fields.mapInArrow(scan, f"id {id_type}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.withColumnRenamed("id", id_col)

"""Word shingles of whole texts as 64-bit hashes, a batch of texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .units import byte_view

WORDS = 5
PRIME = 0x9E3779B97F4A7C15
INVERSE = pow(PRIME, -1, 1 << 64)
#: Odd multipliers of the words of a shingle, by place.
PLACES = np.array([pow(PRIME, 2 * i + 3, 1 << 64) for i in range(WORDS)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def word_hashes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs without ASCII white space, A-Z folded), and the number of words before each
    text and the end. A word's hash is a polynomial of its bytes, from differences of one running sum."""
    edges, data = byte_view(texts)
    base = int(edges[0])
    edges = edges.astype(np.int64) - base
    body = data[base : base + edges[-1]]
    body = np.where((body >= 0x41) & (body <= 0x5A), body + 0x20, body)
    inside = (body != 0x20) & ((body < 0x09) | (body > 0x0D))
    edge = np.zeros(len(body) + 1, bool)
    edge[edges] = True
    before = np.concatenate(([False], inside[:-1])) if len(body) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate((inside[1:], [False])) if len(body) else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum((body.astype(np.uint64) + np.uint64(1)) * _powers(PRIME, len(body))[:-1])))
    hashes = (running[ends] - running[starts]) * _powers(INVERSE, len(body))[starts]
    return mix(hashes + (ends - starts).astype(np.uint64)), np.searchsorted(starts, edges)


def shingle_sets(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, ascending inside a text, and each text's place. A text of fewer
    than ``WORDS`` words has one shingle, its whole sequence; one without words has none."""
    words, at = word_hashes(texts)
    counts = np.diff(at)
    if len(words) >= WORDS:
        rolled = sum(words[i : len(words) - WORDS + 1 + i] * PLACES[i] for i in range(WORDS))
        rolled = mix(rolled + np.uint64(WORDS))
    else:
        rolled = np.zeros(0, np.uint64)
    sets = []
    for a, n in zip(at.tolist(), counts.tolist()):
        if n >= WORDS:
            own = np.sort(rolled[a : a + n - WORDS + 1])
            sets.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif n:
            sets.append(mix((words[a : a + n] * PLACES[:n]).sum(keepdims=True) + np.uint64(n)))
        else:
            sets.append(rolled[:0])
    edges = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)
    return (np.concatenate(sets) if sets else rolled[:0]), edges


def signatures(tokens: np.ndarray, edges: np.ndarray, salt: int) -> np.ndarray:
    """One 64-bit number per set, the same for equal sets."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(tokens ^ np.uint64(salt)))))
    return mix(total[edges[1:]] - total[edges[:-1]] + np.diff(edges).astype(np.uint64)).view(np.int64)

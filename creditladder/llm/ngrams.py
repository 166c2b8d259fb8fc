"""Hashed character n-grams of distinct words, all words of a batch at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Multipliers of the n-gram hash, one per place; odd, fixed so that models and scores agree everywhere.
PLACES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0x2545F491], np.uint64)


def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(1 << 16)])


class WordNgrams:
    """``sizes`` of n-grams into ``buckets`` ids. ``letters_only``: small letters count, all else is a word
    end; otherwise only white space is. A word end stands before and after each word."""

    def __init__(self, sizes: tuple[int, ...], buckets: int, letters_only: bool):
        self.sizes, self.buckets, self.letters_only = sizes, buckets, letters_only
        self.letter = _letters() if letters_only else None

    def __call__(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all n-grams in word order, number of n-grams of each word)."""
        if self.letters_only:
            words = pc.utf8_lower(words)
        lengths = pc.utf8_length(words).to_numpy().astype(np.int64)
        n = len(words)
        text = "".join(words.to_pylist())
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        low = np.minimum(codes, (1 << 16) - 1).astype(np.int64)
        inner = self.letter[low] if self.letters_only else codes > 0x20
        owner = np.repeat(np.arange(n), lengths)
        slots = np.zeros(len(codes) + n + 3, np.uint64)
        slots[np.arange(len(codes)) + owner + 1] = np.where(inner, codes, 0)
        of_slot = np.zeros(len(slots), np.int64)
        of_slot[np.arange(len(codes)) + owner + 1] = owner
        of_slot[np.cumsum(lengths + 1) - lengths - 1] = np.arange(n)
        found, owners = [], []
        size = len(codes) + n + 1
        for k in self.sizes:
            first = slots[:size]
            if k == 1:
                valid = first != 0
            else:  # no word end inside; at most one at either side
                valid = (slots[1:] != 0)[:size] if k > 2 else (first != 0) | (slots[1 : size + 1] != 0)
                for j in range(2, k - 1):
                    valid = valid & (np.roll(slots, -j)[:size] != 0)
            at = np.flatnonzero(valid)
            at = at[at + k <= size]
            mixed = np.full(len(at), k * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
            for j in range(k):
                mixed ^= (slots[at + j] + np.uint64(j + 1)) * PLACES[j]
                mixed *= np.uint64(0xD6E8FEB86659FD93)
                mixed ^= mixed >> np.uint64(32)
            found.append((mixed % np.uint64(self.buckets)).astype(np.int32))
            owners.append(of_slot[at])
        ids, own = np.concatenate(found), np.concatenate(owners)
        return ids[np.argsort(own, kind="stable")], np.bincount(own, minlength=n)


def spread(codes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram ids of a sequence of words, and how many each word of the sequence has."""
    n = sizes[codes]
    done = np.cumsum(n) - n
    firsts = (np.cumsum(sizes) - sizes)[codes]
    return ids[np.repeat(firsts - done, n) + np.arange(int(n.sum()))], n

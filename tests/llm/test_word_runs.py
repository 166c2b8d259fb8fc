"""Periodic runs against a plain scan of all periods."""

from __future__ import annotations

import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from creditladder.llm.word_runs import find_runs, re_pair, runs


def runs_by_hand(x):
    found = []
    for q in range(1, len(x) // 4 + 1):
        i = 0
        while i + q < len(x):
            s = i
            while i + q < len(x) and x[i] == x[i + q]:
                i += 1
            if i - s + q >= max(6, 4 * q) and i > s:
                found.append((s, i - s + q, q))
            i += 1
    shortest = [r for r in found if not any(q < r[2] and s <= r[0] and s + n >= r[0] + r[1] for s, n, q in found)]
    return sorted(shortest, key=lambda r: (r[0], r[2]))


pieces = st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 8), st.integers(0, 5))


@given(parts=st.lists(pieces, max_size=6), twice=st.booleans())
@settings(max_examples=400, deadline=None)
def test_runs_are_those_of_a_plain_scan(parts, twice):
    x = [w for unit, times, cut in parts for w in (unit * times)[cut:]]
    x = x + x if twice else x
    assert runs(np.array(x, np.int64)) == runs_by_hand(x)


@given(x=st.lists(st.integers(0, 2), max_size=80))
@settings(max_examples=200, deadline=None)
def test_grammar_derives_its_text(x):
    symbols = list(x)
    rules, begins, left = re_pair(symbols, 3)

    def derive(s):
        return [s] if s < 3 else derive(rules[s - 3][0]) + derive(rules[s - 3][1])

    assert [w for i in left for w in derive(symbols[i])] == x
    assert all(x[at : at + len(derive(3 + k))] == derive(3 + k) for k, at in enumerate(begins))
    pairs = [(symbols[a], symbols[b]) for a, b in zip(left, left[1:])]
    assert all(pairs.count(p) == 1 or p[0] == p[1] for p in pairs)


@pytest.mark.parametrize("words", [[0] * 100_000, [1, 2, 3] * 30_000, list(range(20_000)) * 5, [bin(i).count("1") % 2 for i in range(1 << 16)]])
def test_long_texts_take_seconds(words):
    start = time.perf_counter()
    runs(np.array(words))
    assert time.perf_counter() - start < 10


def test_odd_rows(spark, odd_docs, no_docs):
    assert find_runs(no_docs).count() == 0
    got = find_runs(odd_docs).collect()
    want = odd_docs.collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in want)
    for r in got:
        texts = {(d.text or "") for d in want if d.doc_id == r.doc_id}
        assert r.collapsed is not None and r.n_words in {len(t.encode().split()) for t in texts}
    texts = [None, "", " \n", "a " * 7, "x a b a b a b a b\ty", "ü v " * 9, "A a " * 3]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    found = {r.doc_id: ([tuple(x) for x in r.runs], r.collapsed) for r in find_runs(rows).collect()}
    assert found == {
        0: ([], ""), 1: ([], ""), 2: ([], ""), 3: ([(0, 7, 1)], "a"), 4: ([(1, 8, 2)], "x a b y"),
        5: ([(0, 9, 1)], "ü v"), 6: ([], "A a A a A a"),
    }

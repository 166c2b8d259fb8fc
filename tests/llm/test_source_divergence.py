"""The divergence of sources against a plain calculation."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from creditladder.llm import source_divergence
from creditladder.llm.source_divergence import HELD_TERMS, divergence, pair_corrections, tree


def divergence_by_hand(rows, least_docs, top):
    terms = [
        (lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
        for lang, source, text in rows
    ]
    out = []
    for lang in {x[0] for x in terms}:
        docs, counts = Counter(), defaultdict(Counter)
        for _, source, words in (x for x in terms if x[0] == lang):
            docs.update(set(words))
            counts[source].update(words)
        kept = [t for t, n in docs.items() if n >= least_docs]
        total = {s: sum(c[t] for t in kept) for s, c in counts.items()}
        everywhere = Counter()
        for c in counts.values():
            everywhere.update(c)

        def share(n, of):
            return 1 + 1_000_000_000 * (n + 5) // (of + 5 * len(kept))

        for s, c in counts.items():
            pairs = [(sum(abs(share(c[t], total[s]) - share(counts[o][t], total[o])) for t in kept), o) for o in counts if o != s]
            more = [(share(c[t], total[s]) - share(everywhere[t], sum(total.values())), t) for t in kept if c[t]]
            for part, found, most in (("pair", pairs, None), ("term", [x for x in more if x[0] > 0], top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, f, k) for k, (f, item) in enumerate(ranked, 1)]
    return sorted(out)


def listed(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def make_rows(seed, n, sources, vocabulary):
    rng = random.Random(seed)
    words = [rng.choice(["", "É", "ß"]) + "".join(rng.choice("abcXYZ") for _ in range(rng.randint(1, 3))) for _ in range(vocabulary)]
    rows = []
    for _ in range(n):
        text = "".join(words[min(int(rng.expovariate(0.08)), vocabulary - 1)] + rng.choice([" ", "\n", "1", ", ", "-"]) for _ in range(rng.randint(0, 40)))
        rows.append((rng.choice(["en", "de", "", None]), rng.choice(["hot"] * sources + [f"s{i}" for i in range(sources)] + [None]), text))
    return rows + [("fr", "only", "42 %"), ("fr", "other", None), ("xx", "alone", "word"), (None, None, None)]


def test_against_plain_calculation(spark, monkeypatch):
    rows = make_rows(3, 300, 9, 60)
    frame = spark.createDataFrame(rows, "lang string, source string, text string")
    assert listed(divergence(frame.repartition(7), least_docs=4, top=6)) == divergence_by_hand(rows, 4, 6)
    monkeypatch.setattr(source_divergence, "HELD_TERMS", 20)
    assert HELD_TERMS > 20
    assert listed(divergence(frame, least_docs=1, top=50)) == divergence_by_hand(rows, 1, 50)
    assert listed(divergence(frame, least_docs=10_000)) == divergence_by_hand(rows, 10_000, 50)


def test_odd_rows(spark, odd_docs, no_docs):
    assert divergence(no_docs).count() == 0
    rows = [(r.lang, r.source, r.text) for r in odd_docs.collect()]
    renamed = odd_docs.select("*", *[odd_docs[c].alias(n) for c, n in (("id", "term"), ("key", "path"), ("row", "value"), ("node", "place"))])
    assert listed(divergence(renamed, least_docs=2)) == divergence_by_hand(rows, 2, 50)


paths = st.lists(st.dictionaries(st.integers(1, 6), st.integers(1, 3), min_size=1, max_size=6), min_size=1, max_size=25)


@given(terms=paths)
@settings(max_examples=150, deadline=None)
def test_tree_gives_the_corrections_of_all_paths(terms):
    """Every path's pairs, one by one, against the tree; p = 10 * n * place, and place is the share at 0."""
    rows = sorted([(s, n, 10 * n * s, s) for s, n in sorted(t.items())] for t in terms)
    items, links = tree(rows)
    assert links[1][links[0] < 0].sum() == len(rows) and len({(int(p), *map(int, i)) for p, i in zip(links[0], items)}) == len(items)
    want = Counter()
    for row in rows:
        for k, (s, _, a, x) in enumerate(row):
            for t, _, b, y in row[k + 1 :]:
                want[s, t] += abs(a - b) - abs(a - y) - abs(x - b) + abs(x - y)
    pairs, sums = pair_corrections(items, links)
    got = {(int(p >> 31), int(p & (2**31 - 1))): int(v) for p, v in zip(pairs, sums)}
    assert got == {k: v for k, v in want.items()}
    assert pair_corrections(*tree([]))[0].size == 0 and np.array_equal(tree([[(1, 1, 1, 1)]] * 3)[1], [[-1], [3]])

"""Licence scans against a plain search."""

from __future__ import annotations

import random
import re

import pytest

import __spark_entry__ as entry_points
from creditladder.llm import licenses
from creditladder.llm.license_texts import BASE, PASSAGES, Passage
from creditladder.llm.licenses import Index, scan_licenses, words_of


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base_by_hand(text):
    words = plain_words(text)
    out = []
    for passage in BASE:
        p = passage.text.split()
        out += [(i, passage.label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return words, out


def hits_by_hand(words, index):
    """Every passage tried at every place."""
    out = []
    for t in index.templates:
        if t.exact:
            continue
        rare = t.rarest(set(words), index.weights)
        for o in range(-len(t.words), len(words)):
            spans = []
            for k, (phrase, at) in enumerate(t.phrases):
                near = [p for p in range(o + at - (k and t.drift), o + at + (k and t.drift) + 1) if p >= 0 and words[p : p + len(phrase)] == phrase]
                spans += [min(near, key=lambda p: abs(p - o - at))] if near else []
            agreeing = sum(any(words[i] == w and abs(i - j - o) <= t.drift for i in range(len(words)) for j, x in enumerate(t.words) if x == w) for w in rare)
            if len(spans) == len(t.phrases) and 3 * agreeing >= 2 * len(rare):
                out.append((t.label, min(spans), max(s + len(p) for s, (p, _) in zip(spans, t.phrases))))
    return sorted(out)


@pytest.fixture(scope="module")
def files():
    """Passages whole, changed, cut and side by side in noise that is full of their words."""
    rng = random.Random(4)
    every = [w for p in PASSAGES + BASE for w in p.text.split()] + ["der", "Ärger", "x"]
    texts = []
    for k in range(120):
        parts = []
        for _ in range(rng.randint(0, 3)):
            words = rng.choice(PASSAGES + BASE).text.split()
            for _ in range(rng.randint(0, k % 7)):
                i = rng.randrange(len(words))
                words[i : i + 1] = rng.choice([[], ["Acme"], [words[i], rng.choice(every)]])
                words = words or ["x"]
            parts += [rng.choice([" ", "\n// ", "-"]).join(words), " ".join(rng.choice(every) for _ in range(rng.randint(0, 12)))]
        texts.append("\n".join(parts))
    return texts + ["CC-BY-NC, cc by nc by nc", "cc by cc by nc", "under THE\tMIT\x00license", "", None, " \n", "undér the mit license"]


def test_hits_are_those_of_a_plain_search(files):
    words = [plain_words(t) for t in files]
    assert words == [[w.decode() for w in words_of((t or "").encode())] for t in files]
    found: dict[bytes, int] = {}
    for own in words:
        for w in set(own):
            found[w.encode()] = found.get(w.encode(), 0) + 1
    index = Index(BASE, PASSAGES, len(files), found)
    several = 0
    for own in words:
        own = [w.encode() for w in own]
        hits = index.hits(own)
        assert sorted(h[:3] for h in hits if not h[4]) == hits_by_hand(own, index)
        assert all(0 < h[3] <= 1 for h in hits)
        several += len(hits) > 1
    assert several > 10


def test_every_passage_is_found_whole():
    index = Index(BASE, PASSAGES)
    for passage in PASSAGES:
        hits = index.hits(words_of(("Some words before. " + passage.text + " and after").encode()))
        assert any(h[0] == passage.label and h[3] > 0.99 for h in hits), passage
        assert len({h[0] for h in hits}) == 1, passage
    with pytest.raises(ValueError):
        Index((), [Passage("x", "a b c", ("c a",))])


def test_query_on_files(spark, files, tmp_path):
    spark.createDataFrame([(i, t) for i, t in enumerate(files)], "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in entry_points.queries()["op11_license_scan"](spark, str(tmp_path)).collect()}
    assert len(got) == len(files)
    for i, text in enumerate(files):
        words, base = base_by_hand(text)
        r = got[i]
        starts = [p for p, _ in base]
        labels = ",".join(sorted({x for _, x in base}))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(base), min(starts, default=None), max(starts, default=None), labels)
        assert set(filter(None, labels.split(","))) <= set(r.labels.split(",")) and (r.score > 0) == bool(r.labels) and r.score <= 1


def test_frequent_licence_words_are_still_found(spark):
    """One passage in every row: its words are the most frequent ones of the corpus."""
    rows = [(i, PASSAGES[0].text + f" {i}") for i in range(50)] + [(50, "license " * 20_000)]
    found = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert all([h.label for h in r.hits] == ["mit"] for r in found if r.doc_id < 50) and not [r for r in found if r.doc_id == 50][0].hits


def test_odd_rows(spark, odd_docs, no_docs):
    assert scan_licenses(no_docs).count() == 0
    assert sorted(str(r.doc_id) for r in scan_licenses(odd_docs).collect()) == sorted(str(r.doc_id) for r in odd_docs.collect())
    n, found = licenses.document_frequencies(odd_docs, {b"a", b"line", b"absent"})
    assert n == odd_docs.count() and b"absent" not in found and found[b"line"] >= 1

"""Language identification, quality classifier and main text: held-out accuracy and odd rows."""

from __future__ import annotations

import html
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry_points
from creditladder.llm import langid, main_text, quality
from creditladder.llm.labelled_pages import labelled_pages
from creditladder.llm.ngrams import WordNgrams, spread
from creditladder.llm.page_blocks import leaf_blocks


def test_ngrams_against_a_loop():
    words = pa.array(["Abc", "x", "", "it's", "é"])
    own = WordNgrams((1, 2, 3), 1 << 30, letters_only=True)
    ids, sizes = own(words)
    # Windows over "|word|" with everything but letters as a word end: none inside, one at either side at most.
    for word, n in zip(words.to_pylist(), sizes.tolist()):
        runs = [r for r in re.split(r"[^a-zé]+", word.lower()) if r]
        assert n == sum(len(r) + (len(r) + 1) + len(r) for r in runs), word
    again, _ = own(pa.array(["zz", "Abc"]))
    assert ids[: sizes[0]].tolist() == again[-sizes[0] :].tolist()
    codes = np.array([3, 0, 0])
    flat, n = spread(codes, ids, sizes)
    assert n.tolist() == sizes[codes].tolist() and flat[n[0] : n[0] + n[1]].tolist() == ids[: sizes[0]].tolist()


def test_language_of_held_out_documents(spark, sf):
    folder = sf("0.01")
    got = entry_points.queries()["op5_language"](spark, folder)
    truth = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and 200 < len(held) < 450
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows) and sum(r.rejected for r in rows) < 20


def test_language_of_odd_rows(odd_docs, no_docs):
    model = langid.fit(odd_docs)
    got = langid.predict(odd_docs, model).collect()
    assert len(got) == odd_docs.count()
    by_text = {}
    for r in langid.predict(odd_docs.withColumn("doc_id", odd_docs.text), model).collect():
        by_text[r.doc_id] = r
    for t in (None, "", " \n\t ", "123 456"):
        assert (by_text[t].lang_pred, by_text[t].score, by_text[t].rejected) == ("und", 0.0, True)
    assert by_text["x"].lang_pred in ("en", "de")
    assert langid.predict(no_docs, model).count() == 0
    empty = langid.fit(no_docs)
    assert {r.lang_pred for r in langid.predict(odd_docs, empty).collect()} == {"und"}
    kept = langid.keep_identified(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.filter("text is null or text = ''").count() == 0


def test_rejects_what_is_far_from_every_language(spark, sf):
    model = langid.fit(spark.read.parquet(f"{sf('0.01')}/documents.parquet"))
    strange = spark.createDataFrame([(1, "жшщ ъыь эюя " * 60)], "doc_id long, text string")
    assert langid.predict(strange, model).first().rejected


def test_fit_has_the_vectors_of_one_language_at_a_time(spark, prose):
    rows = [(i, prose(30, i), f"l{i % 12}") for i in range(12 * 60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    tracemalloc.start()
    model = langid.fit(frame)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(model.language.tolist())) == 12
    assert peak < 16e6, peak  # all at once are 60 * 12 * 4096 counts and weights


def test_clusters_are_unit_and_not_empty():
    rng = np.random.default_rng(1)
    x = np.abs(rng.normal(size=(40, 6)))
    x /= np.linalg.norm(x, axis=1)[:, None]
    centers = langid.cluster(np.vstack((x, x[:1])), 4)
    assert 1 <= len(centers) <= 4 and np.allclose(np.linalg.norm(centers, axis=1), 1)
    assert len(langid.cluster(x[:2], 4)) <= 2


def test_quality_of_held_out_documents(spark, sf):
    folder = sf("0.01")
    rows = entry_points.queries()["op2_quality"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.93
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(5, 1), (5, 1), (7, 0), (9, None), (3, 2), (None, 1)], "doc_id long, quality int")
    model = quality.fit(odd_docs, labels)
    got = quality.score(odd_docs.withColumn("doc_id", odd_docs.text), model).collect()
    by_text = {r.doc_id: r.score for r in got}
    assert len(got) == odd_docs.count() and by_text[None] == by_text[""] == by_text[" \n\t "]
    assert all(0 <= r.score <= 1 for r in got)
    assert quality.score(no_docs, model).count() == 0
    blank = quality.fit(no_docs, labels)
    assert {r.score for r in quality.score(odd_docs, blank).collect()} == {0.5}


def test_margin_is_the_softmax_of_the_mean_embedding():
    """The folded-in score against the plain forward pass over the document's feature list."""
    rng = np.random.default_rng(3)
    model = quality.Model(rng.normal(size=quality.BUCKETS), 0.25)
    features = quality.Features()
    texts = pa.array(["one two two three", "", "x"])
    codes, starts, ids, sizes, singles, pairs, first = features.words(texts)
    for i, got in enumerate(model.score(texts, features)):
        own = codes[starts[i] : starts[i + 1]]
        every = [*spread(own, ids, sizes)[0], *singles[own], *pairs[starts[i] : starts[i + 1]][1:]] if len(own) else []
        margin = (model.worth[every].mean() if len(every) else 0) + 0.25
        assert abs(got - 1 / (1 + np.exp(-margin))) < 1e-12
    assert pairs[2] == quality.SAME


def test_leaf_blocks():
    page = (
        "<!doctype html><title>no</title><script>if (a < b) '</p>'</script><style>p{}</style><!-- <p>no</p> -->"
        "<nav><ul><li><a href='/x>y'>Home</a><li>Two</ul></nav><P CLASS=\"x\">One &amp; two&nbsp;<b>three\n\n four<br>five<p>next</div>"
        "<h2>Head</h3><div>a<textarea>no<p></textarea>b<table><tr><td>c<td>d</table>&copy; 1 < 2"
    )
    got = leaf_blocks(page)
    assert [b[0] for b in got] == ["Home", "Two", "One & two three four five", "next", "Head", "ab", "c", "d", "© 1 < 2"]
    assert got[0][2] == 4 and got[0][1][-1][0] == "li" and got[2][1][-2] == ("p", "x")
    assert leaf_blocks("") == [] and [b[0] for b in leaf_blocks("<p")] == ["<p"]
    assert [b[0] for b in leaf_blocks("<p>open <b>never closed")] == ["open never closed"]
    assert [b[0] for b in leaf_blocks("<script>no end")] == [] and [b[0] for b in leaf_blocks("a<!-- no end")] == ["a"]


def test_field_on_unseen_layouts():
    model = main_text.fit()
    wrong = 0
    for page in labelled_pages(100, seed=5):
        want = [b[0] for label, markup in page if label == 1 for b in leaf_blocks(markup)]
        wrong += main_text.main_blocks("".join(m for _, m in page), model) != want
    assert wrong <= 4


def test_decoding_finds_the_best_labels():
    import itertools

    rng = np.random.default_rng(2)
    for _ in range(20):
        model = main_text.Field({"bias": 0.0}, rng.normal(size=(2, 2)), rng.normal(), rng.normal())
        scores = rng.normal(size=6)
        model.emission = lambda block: scores[block]  # type: ignore[method-assign]

        def value(labels):
            v = sum(scores[i] for i in range(6) if labels[i]) + labels[0] * model.first + labels[-1] * model.last
            return v + sum(model.turn[a, b] for a, b in zip(labels, labels[1:]))

        best = max(itertools.product((0, 1), repeat=6), key=value)
        assert tuple(model.decode(list(range(6)))) == best


ENDLESS = {
    "nested": "<div>" * 200_000 + "x",
    "nested texts": '<div class="a">x' * 60_000,
    "distinct classes": "".join(f'<div class="c{i}">x' for i in range(40_000)),
    "no tag ends": "<a " * 300_000,
    "no quote ends": "<a '" * 250_001 + ">",
    "mixed quotes": "<a \"<b '" * 120_000 + ">",
    "declarations": "<!d " * 200_000,
    "closing nothing": "<div>" * 100_000 + "</section>" * 60_000 + "</span>" * 60_000,
    "raw elements": "<svg>x" * 150_000,
    "limits": "<td><p><button>" + "<div>" * 100_000,
}


@pytest.mark.parametrize("name", ENDLESS)
def test_long_pages_take_seconds(name):
    model = main_text.fit(20)
    start = time.perf_counter()
    main_text.main_blocks(ENDLESS[name], model)
    assert time.perf_counter() - start < 15


def test_quotes_decide_where_a_tag_ends():
    cases = {
        "<a href='x>y'>z": ["z"], "<a href='x>y>z": ["<a href='x>y>z"], "a < b <p>c": ["a < b", "c"], "<x\"a b\" c>d": ["d"],
        "<b 'p' \"q>r\">s": ["s"], "<!x>a<!y": ["a<!y"], "<p title=\"'\">a<p>b": ["a", "b"], "<1>a": ["<1>a"], "</p x='>'>a": ["a"],
    }
    assert {c: [b[0] for b in leaf_blocks(c)] for c in cases} == cases


def test_main_text_of_all_pages(spark, sf):
    folder = sf("0.001")
    got = {r.page_id: r for r in entry_points.queries()["op3_main_text"](spark, folder).collect()}
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        inner = re.search(r"(?s)<article>(.*)</article>", p.html)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"<p>|</p>|</h1>", inner)]
        assert got[p.page_id].text == "\n\n".join(b for b in blocks if b)
        assert got[p.page_id].n_chars == len(got[p.page_id].text)


def test_main_text_of_odd_rows(spark):
    rows = [(1, None, None), (1, "u", ""), (None, "u", "<p>"), (2, "u", "no markup at all"), (3, "u", "<nav>" * 500 + "x" * 100_000)]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, text string")
    got = main_text.extract(pages, main_text.fit()).collect()
    assert len(got) == 5 and [r.text for r in got[:3]] == ["", "", ""]
    assert main_text.extract(pages.limit(0), main_text.fit(20)).count() == 0

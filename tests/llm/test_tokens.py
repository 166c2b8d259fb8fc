"""Token counts and packing against the tokenizer library itself."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import __spark_entry__ as entry_points
from creditladder.llm import packing, token_counts
from creditladder.llm.units import Encoder, balanced, cut_units, slices, text_column

BYTES, FOLDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
CODERS = {path: (Encoder(path, folds), Tokenizer.from_file(path)) for path, folds in ((BYTES, False), (FOLDS, True))}
PIECES = ["a", "Word", "don't", "'s", " ", "  ", "\n", "\t", " ", " ", "\x1c", "\x85", "é", "É", "H̱", "|", "<|endoftext|>", "<|", "|>", "1", "42", ",", "!!", "😀", "ſ", "K", "　", "x" * 50]


@pytest.mark.parametrize("path", [BYTES, FOLDS])
@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), max_size=5))
def test_units_give_the_librarys_ids(path, texts):
    coder, library = CODERS[path]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    column = pa.array(texts, pa.string())
    assert coder.lengths(column).tolist() == [len(w) for w in want]
    ids, edges = coder.ids(column, 1)
    assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:])] == [[*w, 1] for w in want]


def test_units_put_together_are_the_text():
    texts = pa.array(["a b\nc", "", "x", "é ü", None])
    units, starts = cut_units(text_column(texts))
    assert ["".join(units[a:b].to_pylist()) for a, b in zip(starts, starts[1:])] == ["a b\nc", "", "x", "é ü", ""]


def test_batches_are_balanced_and_whole():
    values = ["ab" * n for n in range(50)]
    batches = list(balanced(values, 100))
    assert [v for b in batches for v in b] == values and all(len(b) == 1 or sum(map(len, b)) <= 100 for b in batches)


def test_slices_are_whole():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10] * 7 + [None, "b" * 90])], ["t"])
    assert pa.Table.from_batches(list(slices(batch, "t", 25))).column("t").to_pylist() == batch.column("t").to_pylist()


def test_counts_of_odd_rows(odd_docs, no_docs):
    got = token_counts.count_tokens(odd_docs, BYTES).collect()
    library = CODERS[BYTES][1]
    rows = odd_docs.collect()
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert token_counts.count_tokens(no_docs, BYTES).count() == 0


def unpacked(pieces):
    return np.frombuffer(bytes(pieces), "<u4")


@pytest.mark.parametrize("group_tokens", [3000, 2_000_000])
def test_packing_is_a_round_trip_without_padding(odd_docs, no_docs, group_tokens):
    pieces = packing.pack(odd_docs, FOLDS, group_tokens=group_tokens).collect()
    library = CODERS[FOLDS][1]
    want = sorted([*library.encode(r.text or "", add_special_tokens=False).ids, 1] for r in odd_docs.collect())
    documents, sequences = {}, {}
    for p in pieces:
        assert len(unpacked(p.ids)) == p.length > 0
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end == 2048 or end & (end - 1) == 0
    # Rows of one id cannot be told apart in the result; ids that occur once can.
    for p in sorted((p for p in pieces if p.doc_id in (0, 1, 6, 8, 9)), key=lambda p: p.start):
        at = documents.setdefault(p.doc_id, [])
        assert p.start == len(at)
        at += unpacked(p.ids).tolist()
    assert all(v in want for v in documents.values())
    assert sum(p.length for p in pieces) == sum(map(len, want))
    assert packing.pack(no_docs, FOLDS).count() == 0


def test_assignment_goes_to_the_cheapest_with_room():
    places = packing.assign(np.array([5, 3, 8, 4, 20, 2]), 8, 1.0, 1.0)
    room = packing.capacities(42, 8)
    assert room.tolist() == [8, 8, 8, 8, 8, 2]
    used = np.zeros(6, int)
    for _, _, n, s, offset in places:
        assert offset == used[s]
        used[s] += n
    assert used.tolist() == room.tolist()
    assert [p[2] for p in places[:3]] == [8, 8, 8]


def test_queries(spark, sf, sample):
    folder = sf("0.001")
    library = CODERS[BYTES][1]
    got = {r.doc_id: r for r in entry_points.queries()["op6_token_counts"](spark, folder).collect()}
    for r in sample:
        n = len(library.encode(r.text, add_special_tokens=False).ids)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_bytes, got[r.doc_id].over_limit) == (n, len(r.text.encode()), n > 512)
    library = CODERS[FOLDS][1]
    ids = {r.doc_id: np.array([*library.encode(r.text, add_special_tokens=False).ids, 1], "<u4") for r in sample}
    seen = dict.fromkeys(ids, 0)
    for p in sorted(entry_points.queries()["op4_pack_sequences"](spark, folder).collect(), key=lambda p: p.start):
        own = ids[p.doc_id]
        assert p.start == seen[p.doc_id] and p.doc_tokens == len(own)
        assert p.ids_crc32 == zlib.crc32(own[p.start : p.start + p.length].tobytes())
        seen[p.doc_id] += p.length
    assert seen == {k: len(v) for k, v in ids.items()}


@pytest.mark.parametrize("kind", ["short", "decimal(20,0)", "double", "date", "binary"])
def test_packing_keeps_ids_of_any_type(spark, kind):
    start = "date_add(date'2020-01-01', cast(id as int))" if kind == "date" else f"cast(id as {kind})" if kind != "binary" else "cast(cast(id as string) as binary)"
    docs = spark.range(5).selectExpr(f"{start} as doc_id", "concat('text ', id) as text")
    got = packing.pack(docs, FOLDS)
    assert got.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    assert sorted(map(str, {r.doc_id for r in got.collect()})) == sorted(map(str, {r.doc_id for r in docs.collect()}))

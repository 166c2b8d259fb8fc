from __future__ import annotations

import random

import pytest

WORDS = "the of and la que der und estos haber lire nicht wald river stone green house mesa livre porte silla".split()


@pytest.fixture(scope="session")
def prose():
    """prose(n, seed): a text of n words."""

    def make(n: int, seed: int) -> str:
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) + rng.choice("aeiou") * rng.randint(0, 2) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd_docs(spark, prose):
    """Nulls in every column, empty, blank, very long and repeated texts, ties, and columns whose names the
    operators use inside."""
    long = prose(40_000, 1)
    texts = [None, "", " \n\t ", "x", "one two three", prose(80, 2), prose(80, 2), long, "é" * 3000, "<|endoftext|> a  b   c  d", "123 456", prose(60, 3) + "\nA line.\nA line."]
    rows = [(i, t, ["en", "de", None][i % 3], ["a", None, "b"][i % 3]) for i, t in enumerate(texts)]
    rows += [(5, texts[5], "en", "a"), (5, texts[5], "en", "a"), (None, texts[5], None, None), (None, None, None, None), (7, "another text of the id seven", "de", "b")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, id long, node string, key string, row int, n_tokens string, mix_slot int, score string"
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, "n", "k", 1, "t", 9, "s") for r in rows], schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def sample(spark, sf):
    """The smallest folder's documents as a list of rows."""
    return spark.read.parquet(f"{sf('0.001')}/documents.parquet").collect()

"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled_pages import labelled_pages
from .page_blocks import Path, leaf_blocks
from .units import slices

PAGES = 700
ROUNDS = 200
RATE = 0.3
RIDGE = 1e-4
KNOWN_PATHS = 50_000

#: What class, id and role words hint at.
HINTS = {
    "ad": r"^(ads?|adv|adverts?|advertis\w*|sponsor\w*|promo\w*|banner|dfp|adsense)$",
    "notice": r"cookie|consent|gdpr|notice|alert|popup|modal|newsletter|subscri|dialog|overlay|toast|privacy",
    "comment": r"comment|repl(y|ies)|discuss|respon[sd]|disqus|reader|feedback",
    "side": r"^side|sidebar|widget|related|recommend|more|trending|popular|^rail|complementary",
    "menu": r"^nav|menu|breadcrumb|toolbar|pagination|pager|^tabs?$|^skip",
    "foot": r"foot|copyright|legal|contentinfo|credits",
    "head": r"^head|masthead|logo|topbar|hero",
    "share": r"share|social|follow|tags?$|author|byline|meta$",
    "form": r"form|search|login|signup|input",
    # Last, since a word of another kind beside it says more.
    "main": r"article|content|post|entry|story|main|body|text",
}
#: Elements that say what their content is; of these, the ones that hold main text.
REGIONS = frozenset("article main nav header footer aside form button select dialog menu".split())
MAIN = frozenset("article main".split())
HINT = {k: re.compile(v) for k, v in HINTS.items()}
WORD = re.compile(r"[a-z]+")


@lru_cache(maxsize=20_000)
def element_features(tag: str, marks: str) -> tuple[frozenset[str], tuple[str, ...]]:
    """Of one element: its tag, hints and words of its class; and what it says of its content, if anything."""
    words = WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", marks).lower())
    hints = [k for k, pattern in HINT.items() if any(map(pattern.search, words))]
    own = frozenset([f"in:{tag}", *[f"class:{w}" for w in words], *[f"hint:{k}" for k in hints]])
    if tag not in REGIONS and not hints:
        return own, ()
    # The first hint counts, "main" being the last.
    kind = hints[0] if hints and hints[0] != "main" else tag if tag in REGIONS else "main"
    side = "main" if set(hints) <= {"main"} and (tag in MAIN or tag not in REGIONS) else "outside"
    return own, (f"near:{kind}", f"near:{side}")


def traits(path: Path, known: frozenset[str] | None = None) -> tuple[frozenset[str], tuple[str, ...]]:
    """The features of a path's elements (of those in ``known``, if given) and what the innermost telling one says. Paths take
    over their parents', and sets that do not grow are shared, so a deep page costs no more than a flat one."""
    new = []
    node: Path | None = path
    while node is not None and node.traits is None:
        new.append(node)
        node = node.parent
    seen, near = node.traits if node is not None else (frozenset(), ())
    for node in reversed(new):
        own, tells = element_features(node.tag, node.marks)
        own = own if known is None else own & known
        if not own <= seen:
            seen = seen | own
        near = tells or near
        node.traits = (seen, near)
    return path.traits


def path_features(path: Path | None) -> list[str]:
    """Of the ancestors: their tags, the block's own tag, hints and words of their classes, and what the innermost telling
    one says."""
    if path is None:
        return ["own:"]
    seen, near = traits(path)
    return sorted({f"own:{path.tag}", *seen, *near})


def text_features(text: str, linked: int) -> list[str]:
    """Of the text: its size, link share, ending, and marks of legal lines."""
    n = text.count(" ") + 1
    share = linked / max(1, len(text))
    return [
        "bias",
        f"words:{min(n.bit_length(), 8)}",
        f"links:{0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.8 else 3}",
        f"end:{'stop' if text[-1] in '.!?…' else 'mark' if not text[-1].isalnum() else 'word'}",
        f"stops:{min(3, text.count('. '))}",
        f"legal:{'©' in text or 'copyright' in text.lower()}",
    ]


@dataclass
class Field:
    """Labels 1 (main text) and 0. ``worth``: a feature's score for 1 over 0; ``turn``: scores of label pairs;
    ``first`` and ``last``: of 1 over 0 at the page's ends."""

    worth: dict[str, float]
    turn: np.ndarray
    first: float
    last: float
    paths: dict[tuple, float] = field(default_factory=dict)
    known: frozenset[str] = frozenset()

    def __post_init__(self):
        self.known = frozenset(self.worth)

    def emission(self, block: tuple[str, Path | None, int]) -> float:
        text, path, linked = block
        seen, near = traits(path, self.known) if path is not None else (frozenset(), ())
        key = (path.tag if path is not None else "", seen, near)
        value = self.paths.get(key)
        if value is None:
            if len(self.paths) >= KNOWN_PATHS:
                self.paths.clear()
            value = self.paths[key] = sum(self.worth.get(f, 0.0) for f in sorted({f"own:{key[0]}", *seen, *near}))
        return value + sum(self.worth.get(f, 0.0) for f in text_features(text, linked))

    def decode(self, blocks: list[tuple[str, Path | None, int]]) -> list[int]:
        """The best labels (Viterbi; ties go to 0)."""
        if not blocks:
            return []
        (t00, t01), (t10, t11) = self.turn.tolist()
        zero, one, back = 0.0, self.emission(blocks[0]) + self.first, []
        for block in blocks[1:]:
            e = self.emission(block)
            to0, to1 = one + t10 > zero + t00, one + t11 > zero + t01
            zero, one = (one + t10 if to0 else zero + t00), e + (one + t11 if to1 else zero + t01)
            back.append((to0, to1))
        label = int(one + self.last > zero)
        labels = [label]
        for step in reversed(back):
            label = int(step[label])
            labels.append(label)
        return labels[::-1]


def train(pages: list[list[tuple[int, str]]]) -> Field:
    """Maximum likelihood with a small ridge, by forward-backward over all pages at once and AdaGrad."""
    names: dict[str, int] = {}
    chains: list[list[tuple[list[int], int]]] = []
    for page in pages:
        chain = []
        marked = "".join(f"\x02{i}\x03{markup}" if label >= 0 else markup for i, (label, markup) in enumerate(page))
        label = 0
        for text, path, linked in leaf_blocks(marked):
            # A piece's number stands before its markup; what precedes it belongs to the piece before.
            found = re.findall(r"\x02(\d+)\x03", text)
            rest = re.sub(r"\s*\x02\d+\x03\s*", "", text)
            if rest and not text.startswith("\x02"):
                chain.append(([names.setdefault(f, len(names)) for f in path_features(path) + text_features(rest, linked)], label))
            if found:
                label = page[int(found[-1])][0]
                if rest and text.startswith("\x02"):
                    chain.append(([names.setdefault(f, len(names)) for f in path_features(path) + text_features(rest, linked)], label))
        if chain:
            chains.append(chain)
    most = max(map(len, chains))
    there = np.zeros((len(chains), most), bool)
    gold = np.zeros((len(chains), most), int)
    ids, cell = [], []
    for i, chain in enumerate(chains):
        for j, (features, label) in enumerate(chain):
            there[i, j], gold[i, j] = True, label
            ids += features
            cell += [i * most + j] * len(features)
    ids, cell = np.array(ids), np.array(cell)
    ends = there.sum(1) - 1
    rows = np.arange(len(chains))
    # Parameters: features, then four turns, then first and last.
    p = np.zeros(len(names) + 6)
    squares = np.full(len(p), 1e-8)
    for _ in range(ROUNDS):
        e = np.bincount(cell, p[ids], minlength=there.size).reshape(there.shape)
        e[:, 0] += p[-2]
        e[rows, ends] += p[-1]
        turn = p[-6:-2].reshape(2, 2)
        score = np.stack((np.zeros_like(e), e), 2)
        ahead = np.zeros((*there.shape, 2))
        ahead[:, 0] = score[:, 0]
        for j in range(1, most):
            step = np.logaddexp(ahead[:, j - 1, :1] + turn[0], ahead[:, j - 1, 1:] + turn[1]) + score[:, j]
            ahead[:, j] = np.where(there[:, j, None], step, ahead[:, j - 1])
        behind = np.zeros((*there.shape, 2))
        total = np.logaddexp(ahead[rows, ends, 0], ahead[rows, ends, 1])
        expected_turn = np.zeros((2, 2))
        for j in range(most - 2, -1, -1):
            nxt = score[:, j + 1] + behind[:, j + 1]
            step = np.logaddexp(turn[:, 0] + nxt[:, :1], turn[:, 1] + nxt[:, 1:])
            behind[:, j] = np.where(there[:, j + 1, None], step, 0)
            pair = np.exp(ahead[:, j, :, None] + turn + nxt[:, None, :] - total[:, None, None])
            expected_turn += pair[there[:, j + 1]].sum(0)
        one = np.where(there, np.exp(ahead[..., 1] + behind[..., 1] - total[:, None]), 0)
        gap = np.where(there, gold - one, 0)
        seen_turn = np.zeros((2, 2))
        both = there[:, 1:]
        np.add.at(seen_turn, (gold[:, :-1][both], gold[:, 1:][both]), 1)
        gradient = np.concatenate(
            (np.bincount(ids, gap.ravel()[cell], minlength=len(names)), (seen_turn - expected_turn).ravel(), [gap[:, 0].sum(), gap[rows, ends].sum()])
        )
        gradient -= RIDGE * there.sum() * p
        squares += gradient**2
        p += RATE * gradient / np.sqrt(squares)
    return Field({k: float(p[i]) for k, i in names.items()}, p[-6:-2].reshape(2, 2).copy(), float(p[-2]), float(p[-1]))


def fit(pages: int = PAGES) -> Field:
    return train(labelled_pages(pages))


def main_blocks(page: str, model: Field) -> list[str]:
    blocks = leaf_blocks(page)
    return [b[0] for b, label in zip(blocks, model.decode(blocks)) if label]


def extract(pages: DataFrame, model: Field, id_col: str = "page_id", keep: tuple[str, ...] = ("url",), html_col: str = "html") -> DataFrame:
    """(id, kept columns, text) of every page: the blocks of the main text, joined by an empty line.

    The whole page is read, in time in proportion to its length. Null and empty pages and pages without main text: empty text. Null ids and repeated
    rows stay rows of their own; other columns are not read. No shuffle.
    """
    fields = pages.select(F.col(id_col).alias("id"), *keep, F.col(html_col).alias("html"))
    names = ["id", *keep]
    schema = ", ".join(f"`{n}` {fields.schema[n].dataType.simpleString()}" for n in names)
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in slices(batch, "html"):
                texts = ["\n\n".join(main_blocks(page or "", own)) for page in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array(texts, pa.string())], [*names, "text"])

    return fields.mapInArrow(read, f"{schema}, text string").withColumnRenamed("id", id_col)

"""Secrets in texts: three fixed patterns, and strings that a tokenizer's vocabulary compresses badly."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .units import slices, text_column

# The base kinds in their order, each with its pattern and the least size of a match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "token")

#: Strings that the token test looks at: long enough, with a letter and a digit.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Known digests (pure hexadecimal of a digest's length) and identifiers (UUIDs) are no secrets.
DIGEST_SIZES = (32, 40, 56, 64, 96, 128)
IDENTIFIER = re.compile(r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}")
PURE_HEX = re.compile(r"[0-9A-Fa-f]+")
CHARS_PER_TOKEN = 2.2

# Every text with a span matches one of these (linear-time patterns; a superset, since they fold more letters).
MAYBE_BASE = r"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{24}"
MAYBE_TOKEN = r"[A-Za-z0-9+/_=-]{16}"

SPAN = "array<struct<kind:string,start:long,end:long>>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches per kind that are long enough; code points, end exclusive."""
    spans = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    spans += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    spans += [("hex", *m.span()) for m in HEX.finditer(text) if len(m[0]) >= HEX_LEAST]
    return spans


def token_spans(text: str, encode, ratio: float, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Candidates of fewer than ``ratio`` characters per token that are no digest or identifier and do not
    overlap a base span. Both lists are walked once."""
    found = []
    covered: list[list[int]] = []
    for start, end in sorted(s[1:] for s in taken):
        if covered and start <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], end)
        else:
            covered.append([start, end])
    k = 0
    for m in CANDIDATE.finditer(text):
        value, (start, end) = m[0], m.span()
        if not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)):
            continue
        if IDENTIFIER.fullmatch(value) or (len(value) in DIGEST_SIZES and PURE_HEX.fullmatch(value)):
            continue
        while k < len(covered) and covered[k][1] <= start:
            k += 1
        if k < len(covered) and covered[k][0] < end:
            continue
        if len(value) < ratio * len(encode(value)):
            found.append(("token", start, end))
    return found


def ranks_encoder(path: str, pattern: str):
    """``encode`` of a rank file under the given splitting pattern."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def _spans(texts: pa.StringArray, encode, ratio: float) -> list[list[tuple[str, int, int]]]:
    maybe = pc.or_(
        pc.match_substring_regex(texts, MAYBE_BASE),
        pc.and_(pc.match_substring_regex(texts, "[0-9]"), pc.match_substring_regex(texts, MAYBE_TOKEN)),
    )
    out: list[list[tuple[str, int, int]]] = [[] for _ in range(len(texts))]
    for i in pc.indices_nonzero(maybe).to_pylist():
        text = texts[i].as_py()
        base = base_spans(text)
        out[i] = sorted(base + token_spans(text, encode, ratio, base), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return out


def find_secrets(
    docs: DataFrame, ranks: str, pattern: str, ratio: float = CHARS_PER_TOKEN, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, spans) for every row: spans of kind assign, access, hex (the base patterns) and token (at least 16
    characters with letters and digits, fewer than ``ratio`` characters per token), by start, then kind.

    The token test looks at runs of letters, digits and ``+/_=-`` with both a letter and a digit; keys of letters
    alone are not told from words. Very long texts take time in proportion to their length.

    ``ranks`` is a tiktoken rank file that every executor can open, ``pattern`` its splitting pattern. Null
    and empty texts: no spans. Null ids and repeated rows stay rows of their own; other columns are not
    read. No shuffle.
    """
    fields = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = fields.schema["id"].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ranks_encoder(ranks, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                found = _spans(text_column(part.column("text")), encode, ratio)
                rows = [[{"kind": k, "start": s, "end": e} for k, s, e in spans] for spans in found]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(rows, span)], ["id", "spans"])

    return fields.mapInArrow(scan, f"id {id_type}, spans {SPAN}").withColumnRenamed("id", id_col)


def mask(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    """The text with each run of overlapping spans replaced by the mark."""
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, ranks: str, pattern: str, mark: str = "[secret]", ratio: float = CHARS_PER_TOKEN, text_col: str = "text") -> DataFrame:
    """The same rows and columns with every secret in the text replaced by ``mark``. Null stays null."""
    schema = docs.schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ranks_encoder(ranks, pattern)
        for batch in batches:
            for part in slices(batch, text_col):
                texts = part.column(text_col)
                found = _spans(text_column(texts), encode, ratio)
                if any(found):
                    texts = pa.array([mask(t, s, mark) if s else t for t, s in zip(texts.to_pylist(), found)], texts.type)
                at = part.schema.get_field_index(text_col)
                yield part.set_column(at, part.schema.field(at), texts)

    return docs.mapInArrow(scan, schema)


def listing(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """Spans of the kinds as text: kind:start:end, joined by commas."""
    wanted = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(wanted, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    """Number of spans of one kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

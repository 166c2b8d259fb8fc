"""Token counts: Arrow batches in, lengths only out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .units import encoder, slices, text_column


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every whole text; ``vocabulary`` is a file of the ``tokenizers`` library
    that every executor can open.

    Lengths are those of the library without added special tokens; special strings inside a text are the
    library's default (one id). Texts are cut at safe boundaries, distinct pieces are encoded in batches of
    equal bytes, and only lengths leave the function. Null text: 0 bytes, 0 tokens; null ids and repeated
    rows stay as rows of their own; other columns are not read, so their names cannot clash. No shuffle.
    """
    fields = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = fields.schema["id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = text_column(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pc.binary_length(texts).cast(pa.int64()), pa.array(coder.lengths(texts))],
                    ["id", "n_bytes", "n_tokens"],
                )

    out = fields.mapInArrow(count, f"id {id_type}, n_bytes long, n_tokens long")
    return out.withColumnRenamed("id", id_col)

"""Operator 9: token counts.

Arrow functions encode batches and return lengths only. Batches hold about
``batch_bytes`` of text whatever the row count, and texts longer than
``split_bytes`` are cut at safe boundaries: a space between two visible ASCII
characters, which no normaliser drops or joins with the space. No vocabulary
piece continues over such a place (checked when the model is loaded), and the
dummy prefix of the following segment stands for the space that is cut, so the
sum of the segments' counts is the count of the text. A text without such a
place, however long, is encoded whole.

Null and empty texts have 0 bytes and 0 tokens. Repeated rows are counted each
time. Ids may be null or repeat; they are passed through. An empty table gives no
rows, and further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_loaded: dict[str, tuple] = {}
_BOUNDARY = re.compile(b"(?<=[!-~]) (?=[!-~])")


def load(model: str):
    """The processor, and whether texts may be cut at spaces; once per worker."""
    if model not in _loaded:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        crossing = any("▁" in sp.id_to_piece(i).lstrip("▁") for i in range(sp.get_piece_size()))
        same = len(sp.encode("a b")) == len(sp.encode("a")) + len(sp.encode("b"))
        plain = sp.encode("a  b") == sp.encode("a") + sp.encode(" b")  # no folding of spaces
        _loaded[model] = sp, same and plain and not crossing
    return _loaded[model]


def cut(text: bytes, limit: int) -> list[bytes]:
    """Segments of about ``limit`` bytes; the space at each cut is left out."""
    if len(text) <= limit:
        return [text]
    out, at = [], 0
    while len(text) - at > limit:
        found = _BOUNDARY.search(text, at + limit - 1)
        if not found:
            break
        out.append(text[at : found.start()])
        at = found.end()
    out.append(text[at:])
    return out


def lengths(texts: list[bytes], model: str, batch_bytes: int, split_bytes: int) -> list[int]:
    sp, safe = load(model)
    counts, batch, owner, held = [0] * len(texts), [], [], 0

    def flush() -> None:
        for row, ids in zip(owner, sp.encode(batch, num_threads=1)):
            counts[row] += len(ids)
        batch.clear()
        owner.clear()

    for row, text in enumerate(texts):
        for part in cut(text, split_bytes) if safe else [text]:
            batch.append(part)
            owner.append(row)
            held += len(part)
            if held >= batch_bytes:
                flush()
                held = 0
    flush()
    return counts


def token_counts(
    docs: DataFrame,
    model: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    batch_bytes: int = 1 << 20,
    split_bytes: int = 1 << 16,
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pc.fill_null(b.column(1), "")
            n = lengths(text.cast(pa.binary()).to_pylist(), model, batch_bytes, split_bytes)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pc.binary_length(text).cast(pa.int64()), pa.array(n, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    source = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return source.mapInArrow(encode, "doc_id long, n_bytes long, n_tokens long")

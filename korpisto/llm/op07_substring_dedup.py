"""Operator 7: removal of repeated token windows by Rabin-Karp hashes.

Each window of ``window`` words has a rolling hash, a polynomial modulo a prime of 61
bits. All windows of all texts are counted in Spark by their hash: those that also
start in a document of lower id are repeated, and they merge into maximal removal
intervals.

The texts are written once in chunks. A chunk sends each hash that it holds once, with
the lowest id among its own holders, so a window that a third of all texts hold is a
row a chunk to any one task. Spark finds the lowest id of each hash, and sends it
to the chunks whose own lowest one is higher. So a chunk knows the lowest id of each
of its windows.

A null id counts as the highest. Rows that share an id don't remove each other's
windows, as neither id is lower. Null and empty texts have no words, texts of fewer
words than ``window`` stay, and very long texts are read whole. An empty table gives
no rows. Further columns are not read; ``without_repeats`` returns them unchanged,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from korpisto.llm.common import BYTE_CODE, chunked, materialise, prefix, spans, text_chunks, words_of
from korpisto.llm.repeats import covered

_LAST = (1 << 63) - 1


def _windows(text: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, place in its text) of all windows of a column of texts."""
    found = []
    for begin, _, data, offsets in text_chunks(text):
        starts, ends, row = words_of(data, offsets)
        p = prefix(spans(prefix(BYTE_CODE[data]), starts, ends))
        at = np.arange(max(0, len(starts) - window + 1))
        at = at[row[at] == row[at + window - 1]] if len(at) else at
        begins = np.searchsorted(row, np.arange(len(offsets)))
        found.append((spans(p, at, at + window).view(np.int64), row[at] + begin, at - begins[row[at]] if len(at) else at))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def _lowest(h: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, and the lowest order of each."""
    sort = np.lexsort((order, h))
    h, order = h[sort], order[sort]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    return h[new], order[new]


def _sent(window: int) -> Callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chunk, order = (b.column(c).to_numpy(zero_copy_only=False) for c in ("chunk", "ord"))
            cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1), len(chunk)] if len(chunk) else []
            for lo, hi in zip(cuts, cuts[1:]):
                h, row, _ = _windows(b.column("text").slice(lo, hi - lo), window)
                h, least = _lowest(h, order[lo:hi][row])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), chunk[lo])), pa.array(h), pa.array(least)], names=["chunk", "h", "ord"])

    return scan


def lower(texts: DataFrame, window: int) -> DataFrame:
    """(chunk, h, low): where a text of lower order than all of a chunk holds one of the chunk's windows. ``texts`` has chunk, ord, text."""
    rows = texts.select("chunk", "ord", "text").mapInArrow(_sent(window), "chunk long, h long, ord long")
    return rows.withColumn("low", F.min("ord").over(Window.partitionBy("h"))).where("low < ord").groupBy("chunk", "h").agg(F.min("low").alias("low"))


def _rewritten(docs: DataFrame, window: int, finish: Callable[[bytes, np.ndarray], object], arrow: pa.DataType, kind: T.DataType, id_col: str, text_col: str, *carry: str, chunk: int = 1 << 22) -> DataFrame:
    """``finish(text, first windows)`` as ``done`` of every text, with its id and carried columns."""
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *carry)
    texts = materialise(chunked(given.withColumn("ord", F.coalesce("id", F.lit(_LAST))), "text", chunk))
    low = materialise(lower(texts, window))

    def rewrite(rows: pa.Table, known: pa.Table) -> pa.Table:
        text, order = rows["text"].combine_chunks(), rows["ord"].to_numpy()
        text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
        h, row, place = _windows(text, window)
        every, least = _lowest(np.concatenate([h, known["h"].to_numpy()]), np.concatenate([order[row], known["low"].to_numpy()]))
        gone = order[row] > least[np.searchsorted(every, h)] if len(h) else np.zeros(0, bool)
        row, place = row[gone], place[gone]
        cuts = np.searchsorted(row, np.arange(len(order) + 1))
        done = [None if t is None and carry else finish((t or "").encode(), place[i:j]) for t, i, j in zip(text.to_pylist(), cuts, cuts[1:])]
        return pa.table([rows["id"], *(rows[c] for c in carry), pa.array(done, arrow)], names=["id", *carry, "done"])

    schema = T.StructType([T.StructField("id", T.LongType()), *(docs.schema[c] for c in carry), T.StructField("done", kind)])
    return texts.groupBy("chunk").cogroup(low.groupBy("chunk")).applyInArrow(rewrite, schema)


def substring_dedup(docs: DataFrame, *, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256."""

    def finish(text: bytes, first: np.ndarray) -> dict:
        words, gone = text.split(), 0
        kept = words
        if len(first):
            out = covered(len(words), first, np.ones(len(first), np.int64), window)
            gone = int(out.sum())
            kept = [w for w, g in zip(words, out.tolist()) if not g]
        return {"n_words": len(words), "n_removed": gone, "kept_sha256": hashlib.sha256(b" ".join(kept)).hexdigest()}

    arrow = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
    kind = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    rows = _rewritten(docs, window, finish, arrow, kind, id_col, text_col)
    return rows.selectExpr("id as doc_id", "done.*")


def without_repeats(docs: DataFrame, *, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input with repeated windows cut from its text; null texts stay null.

    A removed run of words goes with the white space after it; all else keeps
    its bytes.
    """

    def finish(text: bytes, first: np.ndarray) -> str:
        if not len(first):
            return text.decode()
        data = np.frombuffer(text, np.uint8)
        starts, _, _ = words_of(data, np.array([0, len(data)]))
        out = covered(len(starts), first, np.ones(len(first), np.int64), window)
        drop = np.zeros(len(data) + 1, np.int64)
        to = np.append(starts[1:], len(data))
        np.add.at(drop, starts[out], 1)
        np.add.at(drop, to[out], -1)
        return data[np.cumsum(drop[:-1]) == 0].tobytes().decode()

    others = [c for c in docs.columns if c not in (id_col, text_col)]
    packed = docs.select(F.col(id_col), F.col(text_col), F.struct(*[F.col(c) for c in others] or [F.lit(0).alias("none")]).alias("rest of the row"))
    rows = _rewritten(packed, window, finish, pa.string(), T.StringType(), id_col, text_col, "rest of the row")
    fields = {id_col: F.col("id"), text_col: F.col("done")}
    return rows.select(*[fields.get(c, F.col("rest of the row").getField(c)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])

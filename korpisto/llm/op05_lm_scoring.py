"""Operator 5: language-model scoring by cross-entropy difference.

Two bigram models, one of the target texts and one of the background, share one
vocabulary and one smoothing: a bigram's share of its first word's bigrams is
interpolated with the word's own share, with the weight of ``prior`` occurrences
(a Dirichlet prior). They are matched in size too: the counts of the
larger one weigh less, by the ratio of their words, and all of them are used. A
text's score is its mean loss per word under the background model less that
under the target model, in nats; high scores are target-like.

A text is scored without its own counts. So a word or bigram that occurs once in
all texts changes nothing but its own unigram mass, which the unknown word holds,
and the models keep all that occur ``least`` times, so they grow with the corpus.

Counts come from all documents. Texts meet the ids of targets and of held-out texts
in a shuffle join: every target counts as one, held-out texts in neither model, all
others are background. The marked texts are written once, in chunks of about
``chunk`` bytes. A chunk sends its distinct words and bigrams, as sorted 56-bit hashes
with their counts, to the parts of the models that their first bits name; there
are as many parts as the corpus needs. A part adds the counts up and sends each chunk
what the models hold of its own keys, which meets the chunk's texts again. So keys
travel once, and nothing but the models' totals reaches the driver.

Null and empty texts have no words and score 0; very long texts are a chunk of
their own, read whole. Ids may be null or repeat: rows are scored each by its own
text, and a text is target if its id is. With no target texts, or no others, both
models are the same, and every score is 0. An empty table gives no rows. Further
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpisto.llm.common import BYTE_CODE, U64, chunked, coded, decoded, free_shuffles, materialise, mix, prefix, shuffle_partitions, spans, text_chunks, words_of

PRIOR = 0.5
TARGET, HELD_OUT = 1, 2
ALL, START = 0, 2  # keys of all words together and of a text's start; the lowest bit of a key says bigram
BITS = 56  # of a key
_ODD = U64(0x9FB21C651E98DF25)


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word before, word, bigram, text) of every word, all but the last as keys."""
    starts, ends, text = words_of(data, offsets)
    word = spans(prefix(BYTE_CODE[data]), starts, ends)
    first = np.ones(len(text), bool)
    first[1:] = text[1:] != text[:-1]
    word = _key(word)
    before = np.where(first, U64(START), np.roll(word, 1))
    return before, word, _key(mix(before * _ODD + word)) | U64(1), text


def _key(h: np.ndarray) -> np.ndarray:
    return (h >> U64(65 - BITS)) << U64(1)


def marked(base: DataFrame, target_ids: DataFrame, held_out_ids: DataFrame | None) -> DataFrame:
    """(doc_id, text, mark): TARGET, HELD_OUT or 0. An id that is both is a target."""
    lists = [(target_ids, TARGET), *([(held_out_ids, HELD_OUT)] if held_out_ids is not None else [])]
    marks = [ids.select(F.col("doc_id").cast("long").alias("id"), F.lit(mark).alias("mark")) for ids, mark in lists]
    slim = reduce(DataFrame.unionByName, marks).where("id is not null").groupBy("id").agg(F.min("mark").alias("mark")).withColumn("part", F.lit(0))
    # null ids match nothing; their texts are dealt out by a hash instead of all to one task
    part = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(1 << 20)).cast("int") + 1).otherwise(0)
    keys = base.select("*", F.coalesce("doc_id", F.lit(0)).alias("id"), part.alias("part"))
    return keys.join(slim.hint("shuffle_hash"), ["id", "part"], "left").select("doc_id", "text", F.coalesce("mark", F.lit(0)).alias("mark"))


def _by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(chunk, [word before, word, bigram, mark of the text]) of a batch's part of a chunk."""
    for b in batches:
        chunk, marks = (b.column(c).to_numpy(zero_copy_only=False) for c in ("chunk", "mark"))
        cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1), len(chunk)] if len(chunk) else []
        for lo, hi in zip(cuts, cuts[1:]):
            found = []
            for first, _, data, offsets in text_chunks(b.column("text").slice(lo, hi - lo)):
                before, word, gram, text = _grams(data, offsets)
                found.append((before, word, gram, marks[lo + first + text]))
            yield int(chunk[lo]), [np.concatenate(x) for x in zip(*found)]


def _packed(counts: np.ndarray) -> bytes:
    return pa.compress(counts.tobytes(), "zstd", asbytes=True)


def _unpacked(data: list[bytes], sizes: list[int], kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(b"".join(pa.decompress(x, n * width, "zstd", asbytes=True) for x, n in zip(data, sizes)), kind)


KEYS = "part int, chunk long, keys binary, t binary, b binary"
FOUND = "chunk long, keys binary, t binary, b binary, total_t long, total_b long, known_t long, known_b long, known_n long"


def _count(bits: int):
    """Target's and background's counts of a chunk's words and bigrams, by part."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, (before, word, gram, mark) in _by_chunk(batches):
            starts = before == START
            marks = np.concatenate([mark, mark, mark[starts], mark])
            key, place = np.unique(np.concatenate([word, gram, before[starts], np.zeros_like(word)]), return_inverse=True)
            t, b = (np.bincount(place, marks == m, minlength=len(key)).astype("<i4") for m in (TARGET, 0))
            part = (key >> U64(BITS - bits)).astype(np.int32)
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(part)] if len(part) else []
            spans_ = list(zip(cuts, cuts[1:]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[cuts[:-1]]), pa.array(np.full(len(spans_), chunk)), pa.array([coded(key[i:j]) for i, j in spans_], pa.binary()), *(pa.array([_packed(x[i:j]) for i, j in spans_], pa.binary()) for x in (t, b))],
                names=["part", "chunk", "keys", "t", "b"],
            )

    return scan


def _add(least: int):
    """One part of the models: a row for each chunk that asks, and one with the part's totals."""

    def merge(rows: pa.Table) -> pa.Table:
        chunks, lists = rows["chunk"].to_numpy(), [decoded(x) for x in rows["keys"].to_pylist()]
        key, place = np.unique(np.concatenate(lists), return_inverse=True)
        t, b = (np.bincount(place, _unpacked(rows[c].to_pylist(), list(map(len, lists)), "<i4"), minlength=len(key)).astype("<i8") for c in "tb")
        special = (key == ALL) | (key == START)
        kept = (t + b >= least) | (key == START)
        kept[key == ALL] = False
        known = kept & ~special & (key & U64(1) == 0)
        ends = np.cumsum([len(x) for x in lists])
        places = [p[kept[p]] for p in np.split(place, ends[:-1])]
        sums = [int(x[key == ALL].sum()) for x in (t, b)] + [int(x[known].sum()) for x in (t, b)] + [int(known.sum())]
        columns = [[*chunks.tolist(), None], [*(coded(key[p]) for p in places), None], *([*(_packed(x[p]) for p in places), None] for x in (t, b)), *([*[None] * len(places), x] for x in sums)]
        return pa.table([pa.array(x, pa.int64() if k not in (1, 2, 3) else pa.binary()) for k, x in enumerate(columns)], names=[c.split()[0] for c in FOUND.split(", ")])

    return merge


def _own(values: np.ndarray, text: np.ndarray) -> np.ndarray:
    """How often each value occurs in its own text."""
    if not len(values):
        return np.zeros(0)
    order = np.lexsort((values, text))
    v, t = values[order], text[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
    group = np.cumsum(new) - 1
    out = np.empty(len(v))
    out[order] = np.bincount(group)[group]
    return out


@dataclass(frozen=True)
class Size:
    """Of one model: all its words, those in the vocabulary, the vocabulary's size, what a count weighs, whose texts it counts, the prior's weight."""

    words: float
    known: float
    size: int
    weight: float
    mark: int
    prior: float

    def losses(self, counts: np.ndarray, places: tuple[np.ndarray, ...], own: tuple[np.ndarray, ...], total: np.ndarray) -> np.ndarray:
        """Losses of words. Places are -1 where the model has no such key; ``own`` and ``total`` are the text's own counts, if they are in the model."""
        before, word, gram = (np.where(p >= 0, np.maximum(counts[p] - o, 0), 0) * self.weight for p, o in zip(places, own))
        word = np.where(places[1] >= 0, word, (self.words - self.known) * self.weight)
        unigram = (word + PRIOR) / ((self.words - total) * self.weight + PRIOR * self.size)
        return -np.log((gram + self.prior * unigram) / (before + self.prior))


def _rolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A chunk's rows as one compressed value, which is half of what a shuffle makes of them."""
    for b in batches:
        chunk, rows = b.column("chunk").to_numpy(zero_copy_only=False), b.select(["doc_id", "text", "mark"])
        cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1), len(chunk)] if len(chunk) else [0]
        values = []
        for lo, hi in zip(cuts, cuts[1:]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_batch(rows.slice(lo, hi - lo))
            values.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(chunk[cuts[:-1]], pa.int64()), pa.array(values, pa.binary())], names=["chunk", "rows"])


def _score(sizes: tuple[Size, Size], columns: str):
    """Texts of a chunk with what the models hold of them; ``columns`` are the counts of the two models."""

    def scan(chunk: pa.Table, model: pa.Table) -> pa.Table:
        texts = pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in chunk["rows"].to_pylist()])
        lists = [decoded(x) for x in model["keys"].to_pylist()]
        keys, order = np.unique(np.concatenate([np.zeros(0, U64), *lists]), return_index=True)
        keys = np.concatenate([keys, [U64(0)]])  # not empty; no word or bigram is asked for by the last
        counts = [np.append(_unpacked(model[c].to_pylist(), list(map(len, lists)), "<i8")[order], 0).astype(np.float64) for c in columns]

        def place(h: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(keys[:-1], h), len(keys) - 1)
            return np.where(keys[at] == h, at, -1)

        out = []
        column, marks = texts["text"].combine_chunks(), texts["mark"].to_numpy()
        for first, last, data, offsets in text_chunks(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column):
            *grams, text = _grams(data, offsets)
            n = np.bincount(text, minlength=last - first)
            places, own, mark, total = tuple(map(place, grams)), tuple(_own(g, text) for g in grams), marks[first + text], n[text]
            losses = [s.losses(c, places, tuple(np.where(mark == s.mark, o, 0) for o in own), np.where(mark == s.mark, total, 0)) for s, c in zip(sizes, counts)]
            t, g = (np.bincount(text, x, minlength=last - first) / np.maximum(n, 1) for x in losses)
            out.append((n, t, g, g - t))
        found = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64), *[np.zeros(0)] * 3]
        return pa.table([texts["doc_id"], *map(pa.array, found)], names=["doc_id", "n_words", "target_loss", "background_loss", "score"])

    return scan


def cross_entropy_difference(
    docs: DataFrame,
    target_ids: DataFrame,
    held_out_ids: DataFrame | None = None,
    *,
    least: int = 2,
    prior: float = 32.0,
    chunk: int = 1 << 23,
    part_bytes: int = 1 << 25,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, n_words, target_loss, background_loss, score.

    ``target_ids`` has a column doc_id of the target texts and ``held_out_ids`` one of
    texts that are scored but not counted; all other texts are background.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = materialise(chunked(marked(base, target_ids, held_out_ids), "text", chunk))
    free_shuffles(docs.sparkSession)
    volume = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, (max(shuffle_partitions(docs.sparkSession), volume // part_bytes) - 1).bit_length())
    counted = texts.select("text", "mark", "chunk").mapInArrow(_count(bits), KEYS)
    found = materialise(counted.groupBy("part").applyInArrow(_add(least), FOUND))
    free_shuffles(docs.sparkSession)

    sums = found.where("chunk is null").agg(*[F.sum(c) for c in ("total_t", "total_b", "known_t", "known_b", "known_n")]).first()
    words, known, size = ([float(x or 0) for x in sums[k : k + 2]] for k in (0, 2, 4))
    sizes, columns = tuple(Size(words[k], known[k], size[0] + 1, min(words) / words[k] if words[k] else 1.0, mark, prior) for k, mark in enumerate((TARGET, 0))), "tb"
    if not min(words):  # one side has no texts: both models are the other's
        k = int(not words[0])
        sizes, columns = (replace(sizes[k], weight=1.0),) * 2, "tb"[k] * 2

    answers = found.where("chunk is not null").select("chunk", "keys", "t", "b")
    rolled = texts.mapInArrow(_rolled, "chunk long, rows binary")
    pairs = rolled.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    return pairs.applyInArrow(_score(sizes, columns), "doc_id long, n_words long, target_loss double, background_loss double, score double")

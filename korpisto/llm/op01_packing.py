"""Operator 1: packing by shortest-pack-first over the length histogram.

Documents become token ids, then pieces: whole sequences of ``size`` ids and one
remainder. Only the histogram of remainder lengths, at most ``size`` counts,
reaches the driver. There lengths are placed longest first, each into the open
packs with the most room, as counts of packing patterns, never document by
document. Pieces find their place by rank: the rank of a piece among those of
its length selects pattern, pack and slot.

Ranks are made without gathering a length in one task: pieces are counted by
(length, bucket of the id's hash), and a piece's rank is the sum of the buckets before
its own plus its row number within its bucket.

Null and empty texts are the end id alone; very long texts are read whole and cut.
Ids may be null or repeat: rows are packed each on its own, and buckets come from
the piece's number, so rows that share an id don't share a bucket. An empty table
gives no rows. Further columns are not read.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korpisto.llm.common import materialise, shuffle_partitions

_encoders: dict[str, WordEncoder] = {}


#: A pre-tokenizer's pattern whose tokens hold no white space, and part letters, digits and marks. Fixed value.
PARTING = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


#: The characters that stand for bytes that no letter of one byte stands for, in the order of the bytes.
_OTHERS = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_BYTE_LETTERS = {b: 256 + k for k, b in enumerate(_OTHERS)}


def _splits(definition: dict) -> bool:
    """Whether a vocabulary parts words at white space and letters from marks, and folds case, by its own definition.

    Composition and lower case look at no character beyond a space; added tokens
    are matched before all else and must hold no space.
    """
    normal = definition["normalizer"] or {}
    steps = normal.get("normalizers", [])
    folds = [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": "\\s+"} and steps[1]["content"] == " "
    cuts = (definition["pre_tokenizer"] or {}).get("pretokenizers", [])
    parts = [x["type"] for x in cuts] == ["Split", "ByteLevel"] and cuts[0]["pattern"] == {"Regex": PARTING} and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"]
    return folds and parts and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"] and not any(re.search(r"\s", x["content"]) or x["lstrip"] or x["rstrip"] or x["content"].isalpha() for x in definition["added_tokens"])


class WordEncoder:
    """Token ids of texts, remembered by word and by the letters of a word.

    Where the vocabulary's own normaliser and pre-tokenizer say so (``_splits``),
    spaces and line feeds always end a token, so a text's ids are those of its
    space-separated parts; and letters and a run of marks behind them are tokens of
    their own with case folded, so most new words are known letters with other
    marks. Texts of any other vocabulary are encoded whole. Each memory holds up to
    ``keep`` entries of recent use and as many older ones.
    """

    _CORE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")

    def __init__(self, path: str, keep: int = 200_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self.words, self.old_words = {"": b""}, {}
        self.cores, self.old_cores = {"": b""}, {}
        self.model = self.tokenizer.model
        self.by_word = self.by_core = _splits(json.loads(self.tokenizer.to_str()))

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _model_ids(self, word: str) -> bytes:
        """Ids of a word of lower-case letters of ``_CORE``, which are composed: the normaliser leaves it, the pre-tokenizer writes its bytes as characters."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _core(self, core: str) -> bytes:
        """Ids of a core that ``cores`` does not hold."""
        got = self.old_cores.get(core)
        if got is None:
            got = self._model_ids(core) if core.isalpha() else self._ids([core])[0]
        self.cores[core] = got
        return got

    def _learn(self, words: set[str]) -> None:
        """Put words that are not remembered into the memory."""
        if len(self.cores) > self.keep:
            self.cores, self.old_cores = {"": b""}, self.cores
        known, old, match, core, cores = self.words, self.old_words, self._CORE.fullmatch, self._core, self.cores
        whole = []
        for w in words:
            got = old.get(w)
            if got is None:
                m = match(w) if self.by_core else None
                if m is None:
                    whole.append(w)
                    continue
                letters, marks = m.groups()
                letters = letters.lower()
                got = cores.get(letters)
                if got is None:
                    got = core(letters)
                if marks:
                    end = cores.get(marks)
                    got += core(marks) if end is None else end
            known[w] = got
        if whole:
            known.update(zip(whole, self._ids(whole)))

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        for text in texts:
            parts = text.replace("\n", " ").split(" ") if self.by_word else [text]
            missing = set(parts).difference(self.words)
            if missing:
                if len(self.words) > self.keep:
                    self.words, self.old_words = {"": b""}, self.words
                    missing = set(parts) - {""}
                self._learn(missing)
            yield b"".join(map(self.words.__getitem__, parts))


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and a number of every piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), array("I", [end_id]).tobytes()
        serial = TaskContext.get().partitionId() << 40
        for b in batches:
            rows: list[tuple] = []
            for doc, ids in zip(b.column(0).to_pylist(), encode(pc.fill_null(b.column(1), "").to_pylist())):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, size):
                    part = ids[4 * start : 4 * (start + size)]
                    rows.append((doc, start, len(part) // 4, zlib.crc32(part), n))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "serial"]
            numbers = pa.array(np.arange(serial, serial + len(rows)))
            serial += len(rows)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 5)), numbers], names=names)

    source = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return source.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, serial long")


def patterns(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, count) of packs that hold each length as often as the histogram says."""
    done: list[tuple[tuple[int, ...], int]] = []
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []  # sorted keys of open_

    def put(room: int, pattern: tuple[int, ...], count: int) -> None:
        if room == 0:
            done.append((pattern, count))
            return
        if room not in open_:
            bisect.insort(rooms, room)
            open_[room] = []
        open_[room].append((pattern, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if rooms and rooms[-1] >= length:
                room = rooms[-1]
                pattern, count = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop()
                used = min(count, left)
                if used < count:
                    put(room, pattern, count - used)
                put(room - length, (*pattern, length), used)
                left -= used
            else:
                fit = min(size // length, left)
                used = left // fit
                put(size - fit * length, (length,) * fit, used)
                left -= fit * used
    return done + [x for room in rooms for x in open_[room]]


def slots(packs: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, copies in a pack, offset) by pattern and length.

    Equal lengths of a pattern are adjacent; rank r of the range lies in pack
    (r - first) // copies at offset + length * ((r - first) % copies).
    """
    out, used, sequence = [], {}, 0
    for pattern, count in packs:
        at = 0
        for length in sorted(set(pattern), reverse=True):
            copies = pattern.count(length)
            first = used.get(length, 0)
            out.append((length, first, first + copies * count, sequence, copies, at))
            used[length] = first + copies * count
            at += copies * length
        sequence += count
    return out


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    size: int = 4096,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    parts = materialise(pieces(docs, tokenizer, size, end_id, id_col, text_col))
    buckets = max(8, 2 * shuffle_partitions(spark))
    rest = parts.withColumn("bucket", F.pmod(F.xxhash64("serial"), F.lit(buckets)).cast("int"))
    counts = rest.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialise(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))))
    histogram = {r.length: r.n for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    table = slots(patterns(histogram, size))
    within = Window.partitionBy("length", "bucket").orderBy("serial")
    ranked = (
        rest.withColumn("row", F.row_number().over(within) - 1)
        .join(bases.select("length", "bucket", "base").hint("merge"), ["length", "bucket"])  # grows with the buckets
        .withColumn("rank", F.col("base") + F.col("row"))
    )
    ranges: dict[int, list[tuple]] = {}
    for length, *rest_of in table:
        ranges.setdefault(length, []).append(tuple(rest_of))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length = {k: np.array(v, np.int64).T for k, v in ranges.items()}
        for b in batches:
            length, rank = (b.column(k).to_numpy(zero_copy_only=False) for k in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for value in np.unique(length):
                at = np.flatnonzero(length == value)
                first, _, base, copies, start = by_length[value]
                k = np.searchsorted(first, rank[at], "right") - 1
                r = rank[at] - first[k]
                sequence[at] = base[k] + r // copies[k]
                offset[at] = start[k] + value * (r % copies[k])
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    schema = ", ".join(f"{c} long" for c in [*columns, "sequence_id", "offset"])
    return ranked.select(*columns, "rank").mapInArrow(place, schema)

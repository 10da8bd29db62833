"""Bucket-pointer refinement over the strings of all texts: the search of operator 4.

A suffix is looked at by its first ``length`` bytes only, so two suffixes that stay
in one bucket to the end are a repeated string. Suffixes that are alone in their
bucket leave at once; what is sent about the others is a bucket identifier each.

Which suffixes can share a bucket at all, anchors say beforehand. Of its grams of
``gram`` bytes the string of a suffix has its anchor at the one with the lowest hash,
the first of equals; so equal strings have equal anchors at equal places.
Consecutive suffixes of one anchor are a run. Runs are sorted by (gram, whole
content). Equal runs hold equal suffixes: one of them stands for all, and all their
strings are repeated. A run whose gram no other run has holds suffixes of buckets of
one, and leaves. All others are open: none that may repeat is lost. At the edge
of a range partition a run's neighbours are unknown; it then stays open.

Of open runs and of those that stand for several, the suffixes are refined:

1. The initial buckets are the grams of ``INITIAL`` bytes, identified by their value.
2. A bucket of longer strings is identified by the buckets of its suffix and of
   those at later offsets, ``wide`` bytes in all. Chunks of suffixes send their
   distinct identifiers, sorted, to the parts of the order that their first bits
   name; a part sorts them together and answers which ones other suffixes share.
3. The same again, with the identifiers of step 2 at later offsets, makes ``length``
   bytes. Only suffixes whose buckets of step 2 are all shared take part.

Identifiers are polynomials modulo a prime of 61 bits over the identifiers that they
refine, so they need not be sent back. A chunk sends an identifier once however
often it holds it, so a frequent one is a number a chunk to any one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from korpisto.llm.common import BYTE_CODE, U64, coded, decoded, free_shuffles, keyed, materialise, mix, prefix, product, reduced, shuffle_partitions, spans, text_chunks

SETTLED, OPEN, WITNESS = 1, 2, 3  # repeated; undecided; repeated, and others may equal it
INITIAL, FACTOR = 5, 5
_BASE = U64(0x0B3F9C5D71E8A64F)


# ---------------------------------------------------------------- runs of anchors
def anchored_runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, first suffix within it, suffixes, gram's hash, run's hash) of all runs."""
    codes = BYTE_CODE[data]
    n, w, g = len(codes), length, gram
    empty = np.zeros(0, np.int64)
    if n < w:
        return empty, empty, empty, empty.astype(U64), empty.astype(U64)
    p = prefix(codes)
    at = np.arange(n - g + 1)
    bits = U64(32)  # the same for all texts, or equal strings might have different anchors
    low = ((spans(p, at, at + g) >> bits) << bits) | at.astype(U64)
    size, need = 1, w - g + 1  # sliding minimum over ``need`` grams by doubling
    while size * 2 <= need:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < need:
        low = np.minimum(low[: len(low) - (need - size)], low[need - size :])
    anchor = (low & ((U64(1) << bits) - U64(1))).astype(np.int64)
    lengths = np.diff(offsets)
    long = np.flatnonzero(lengths >= w)
    change = np.zeros(len(anchor) + 1, np.int64)
    change[offsets[long]] += 1
    np.add.at(change, offsets[long] + lengths[long] - w + 1, -1)
    valid = np.cumsum(change[:-1]) > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    stop = valid.copy()
    stop[:-1] &= ~valid[1:] | new[1:]
    first, last = np.flatnonzero(new), np.flatnonzero(stop)
    text = np.searchsorted(offsets, first, "right") - 1
    a = anchor[first]
    return text, first - offsets[text], last - first + 1, spans(p, a, a + g), spans(p, first, last + w)


def _groups(*keys: np.ndarray) -> np.ndarray:
    """True where a sorted row differs from the one before it in any key."""
    new = np.ones(len(keys[0]), bool)
    if len(new) > 1:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


RUN = "a long, s long, key long, first int, n int, kind int"


def _runs_of(length: int, gram: int) -> Callable:
    """Runs. Of equal ones in a batch one goes on for all. kind: 0 to compare, 1 settled here, 2 known to repeat and sent on for others."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, found = b.column(0).to_numpy(zero_copy_only=False), []
            for begin, _, data, offsets in text_chunks(b.column(1)):
                text, *rest = anchored_runs(data, offsets, length, gram)
                found.append((text + begin, *rest))
            if not found:
                continue
            text, first, n, a, s = (np.concatenate(c) for c in zip(*found))
            sort = np.lexsort((first, text, s, a))
            text, first, n, a, s = (c[sort] for c in (text, first, n, a, s))
            new = _groups(a, s)
            kind = np.where(new, 0, 1).astype(np.int32)
            if len(a):
                kind[new] = np.where(np.bincount(np.cumsum(new) - 1) > 1, 2, 0)
            spread = mix(key[text].astype(U64) * U64(0x9E3779B97F4A7C15) + first.astype(U64))
            a = np.where(kind == 1, spread, a)
            yield _batch(["a", "s", "key", "first", "n", "kind"], a.view(np.int64), s.view(np.int64), key[text], first.astype(np.int32), n.astype(np.int32), kind)

    return scan


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over runs sorted by (a, s): key, first, n, state of those that are not alone in their bucket."""
    names = ["key", "first", "n", "state"]
    held = None  # first run of the last group: a, s, key, first, n, shared bucket so far, several
    last_a = None

    def state_of(shared, several):
        return np.where(several, np.where(shared, WITNESS, SETTLED), np.where(shared, OPEN, 0)).astype(np.int32)

    def close(after: bool) -> pa.RecordBatch:
        state = state_of(held[5] or after, held[6])
        keep = pa.array([bool(state)])
        return _batch(names, *(np.array([held[k]], t) for k, t in ((2, np.int64), (3, np.int32), (4, np.int32))), state.reshape(1)).filter(keep)

    for b in batches:
        a, s, key, first, n, kind = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        done = kind == 1
        if done.any():
            yield _batch(names, key[done], first[done], n[done], np.full(done.sum(), SETTLED, np.int32))
            a, s, key, first, n, kind = (c[~done] for c in (a, s, key, first, n, kind))
        if not len(a):
            continue
        new = _groups(a, s)
        if held is not None and (a[0], s[0]) == held[:2]:
            new[0] = False
        heads = np.flatnonzero(new)
        if not new[0]:
            held = (*held[:6], True)
        state = np.full(len(a), SETTLED, np.int32)
        if len(heads):
            if held is not None:
                yield close(bool(a[heads[0]] == held[0]))
            before = np.empty(len(heads), bool)
            before[0] = last_a is None or a[heads[0]] == (a[heads[0] - 1] if heads[0] else last_a)
            before[1:] = a[heads[1:]] == a[heads[1:] - 1]
            after = np.append(a[heads[1:]] == a[heads[:-1]], False)
            several = (np.diff(np.append(heads, len(a))) > 1) | (kind[heads] == 2)
            state[heads] = state_of(before | after, several)
            k = heads[-1]
            state[k] = 0  # held until its bucket's next run is known
            held = (a[k], s[k], key[k], first[k], n[k], bool(before[-1]), bool(several[-1]))
        last_a = a[-1]
        told = state > 0
        yield _batch(names, key[told], first[told], n[told], state[told])
    if held is not None:
        yield close(True)


def _lists(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets and fields of a list<struct> column, null lists as empty."""
    flat = column.flatten()
    lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    fields = [flat.field(k).to_numpy(zero_copy_only=False) for k in range(flat.type.num_fields)] if pa.types.is_struct(flat.type) else []
    return np.concatenate([[0], np.cumsum(lengths)]), fields


# -------------------------------------------------------------------- refinement
PIECES = "chunk long, data binary, state binary, place binary"
KEYS = "part int, chunk long, keys binary, several binary"


def _pieces(length: int, chunk_bytes: int) -> Callable:
    """Chunks of the stretches of text that undecided runs and witnesses take.

    ``state`` says of each byte whether a suffix of an open run (OPEN) or of a
    witness starts there, ``place`` holds key, start and end of each stretch.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        data, state, place, held = [], [], [], 0

        def out() -> pa.RecordBatch:
            row = [number], [b"".join(data)], [np.concatenate(state).tobytes()], [np.array(place, "<i8").tobytes()]
            return _batch(["chunk", "data", "state", "place"], *(pa.array(c, t) for c, t in zip(row, (pa.int64(), *[pa.binary()] * 3))))

        for b in batches:
            at, fields = _lists(b.column("runs"))
            for i, (key, text) in enumerate(zip(b.column("key").to_pylist(), b.column("text").to_pylist())):
                first, n, kind = (f[at[i] : at[i + 1]] for f in fields)
                pick = np.flatnonzero(kind != SETTLED)
                if not len(pick):
                    continue
                raw = text.encode()
                marks = np.zeros(len(raw), np.uint8)
                change = np.zeros(len(raw) + 1, np.int64)
                for k in pick:
                    marks[first[k] : first[k] + n[k]] = kind[k]
                    change[first[k]] += 1
                    change[first[k] + n[k] - 1 + length] -= 1
                inside = np.concatenate([[False], np.cumsum(change[:-1]) > 0, [False]])
                edges = np.flatnonzero(inside[1:] != inside[:-1])
                for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist()):
                    data.append(raw[lo:hi])
                    state.append(marks[lo:hi])
                    place.append((key, lo, hi))
                    held += hi - lo
                if held >= chunk_bytes:
                    yield out()
                    number += 1
                    data, state, place, held = [], [], [], 0
        if data:
            yield out()

    return scan


def initial(data: np.ndarray) -> np.ndarray:
    """Identifiers of the buckets of ``INITIAL`` bytes: their value."""
    n = max(0, len(data) - INITIAL + 1)
    return sum((data[k : k + n].astype(U64) << U64(8 * k) for k in range(INITIAL)), np.zeros(n, U64))


def refined(bucket: np.ndarray, width: int, wide: int) -> np.ndarray:
    """Identifiers of buckets of ``wide`` bytes from those of ``width`` bytes at the same and at later offsets."""
    n = max(0, len(bucket) - (wide - width))
    out = bucket[:n]
    for offset in [*range(width, wide - width, width), wide - width] if wide > width else []:
        out = reduced(product(out, np.full(len(out), _BASE)) + bucket[offset : offset + n])
    return out


def _widths(length: int) -> tuple[int, int]:
    return min(INITIAL, length), max(min(INITIAL, length), -(-length // FACTOR))


def _first_round(data: bytes, place: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of the first refinement, and how far each byte's stretch reaches."""
    raw = np.frombuffer(data, np.uint8)
    _, lo, hi = np.frombuffer(place, "<i8").reshape(-1, 3).T
    ends = np.cumsum(hi - lo)
    room = np.repeat(ends, hi - lo) - np.arange(len(raw))
    narrow, wide = _widths(length)
    return refined(initial(raw), narrow, wide), room


def _send(chunk: int, ids: np.ndarray, bits: int) -> pa.RecordBatch:
    """The distinct identifiers of a chunk, by part of the order, with a mark on those that it holds several times."""
    key, count = np.unique(mix(ids), return_counts=True)
    part = (key >> U64(64 - bits)).astype(np.int32)
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(part)] if len(part) else [0]
    pairs = list(zip(cuts, cuts[1:]))
    return _batch(["part", "chunk", "keys", "several"], part[cuts[:-1]], np.full(len(pairs), chunk), pa.array([coded(key[i:j]) for i, j in pairs], pa.binary()), pa.array([np.packbits(count[i:j] > 1).tobytes() for i, j in pairs], pa.binary()))


def _shared(rows: pa.Table) -> pa.Table:
    """One part of the order: for each chunk, which of its identifiers another suffix has too."""
    lists = [decoded(x) for x in rows["keys"].to_pylist()]
    key, place = np.unique(np.concatenate(lists), return_inverse=True)
    marks = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)) for x, k in zip(rows["several"].to_pylist(), lists)]
    several = np.bincount(place, 1 + np.concatenate(marks), minlength=len(key)) > 1
    ends = np.cumsum([len(x) for x in lists])
    told = pa.array([np.packbits(several[p]).tobytes() for p in np.split(place, ends[:-1])], pa.binary())
    return pa.table([rows["chunk"], rows["part"], told], names=["chunk", "part", "shared"])


def _known(ids: np.ndarray, answers: list[dict], bits: int) -> np.ndarray:
    """Which of the identifiers that were sent other suffixes have too."""
    key, place = np.unique(mix(ids), return_inverse=True)
    part = key >> U64(64 - bits)
    out = np.zeros(len(key), bool)
    for a in answers:
        lo, hi = np.searchsorted(part, [U64(a["part"]), U64(a["part"] + 1)])
        out[lo:hi] = np.unpackbits(np.frombuffer(a["shared"], np.uint8), count=hi - lo)
    return out[place]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Chunks one by one."""
    for b in batches:
        for k in range(len(b)):
            yield b.slice(k, 1).to_pylist()[0]


def _round_one(length: int, bits: int) -> Callable:
    wide = _widths(length)[1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ids, room = _first_round(row["data"], row["place"], length)
            yield _send(row["chunk"], ids[room[: len(ids)] >= wide], bits)

    return scan


def _survivors(row: dict, length: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a chunk whose buckets of the first round are all shared, and their final identifiers."""
    wide = _widths(length)[1]
    ids, room = _first_round(row["data"], row["place"], length)
    valid = room[: len(ids)] >= wide
    alive = np.zeros(len(ids), bool)
    alive[valid] = _known(ids[valid], row["first_round"] or [], bits)
    last = refined(ids, wide, length)
    state = np.frombuffer(row["state"], np.uint8)[: len(last)]
    stays = (state > 0) & (room[: len(last)] >= length)
    for offset in [*range(0, length - wide, wide), length - wide]:
        stays &= alive[offset : offset + len(last)]
    at = np.flatnonzero(stays)
    return at, last[at]


def _round_two(length: int, bits: int) -> Callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield _send(row["chunk"], _survivors(row, length, bits)[1], bits)

    return scan


def _decided(length: int, bits: int) -> Callable:
    """Runs of suffixes that are repeated: key, first, n."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            at, ids = _survivors(row, length, bits)
            at = at[_known(ids, row["second_round"] or [], bits)]
            at = at[np.frombuffer(row["state"], np.uint8)[at] == OPEN]
            key, lo, hi = np.frombuffer(row["place"], "<i8").reshape(-1, 3).T
            begin = np.cumsum(hi - lo) - (hi - lo)
            piece = np.searchsorted(begin, at, "right") - 1
            first = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(piece) != 0)])) if len(at) else np.zeros(0, np.int64)
            count = np.diff(np.append(first, len(at)))
            piece = piece[first]
            yield _batch(["key", "first", "n"], key[piece], (at[first] - begin[piece] + lo[piece]).astype(np.int32), count.astype(np.int32))

    return scan


def _repeated(needed: DataFrame, length: int, chunk_bytes: int) -> DataFrame:
    """(key, list of runs of suffixes) of what refinement finds repeated in open runs."""
    spark = needed.sparkSession
    pieces = materialise(needed.mapInArrow(_pieces(length, chunk_bytes), PIECES).repartition(shuffle_partitions(spark), "chunk"))
    volume = pieces.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    bits = max(4, (max(shuffle_partitions(spark), volume >> 22) - 1).bit_length())
    rounds = {"first_round": _round_one, "second_round": _round_two}
    table = pieces
    for name, step in rounds.items():
        sent = table.mapInArrow(step(length, bits), KEYS)
        told = sent.groupBy("part").applyInArrow(_shared, "chunk long, part int, shared binary")
        answers = told.groupBy("chunk").agg(F.collect_list(F.struct("part", "shared")).alias(name))
        table = materialise(table.join(answers, "chunk", "left"))
        free_shuffles(spark)
    found = table.mapInArrow(_decided(length, bits), "key long, first int, n int")
    return found.groupBy("key").agg(F.collect_list(F.struct("first", "n")).alias("late"))


# ------------------------------------------------------------------- whole search
def rewrite(docs: DataFrame, length: int, gram: int, finish: Callable[[bytes, np.ndarray, np.ndarray], tuple], result: str, *, id_col: str, text_col: str, chunk_bytes: int = 1 << 21) -> DataFrame:
    """``finish(text, first suffixes, counts)`` of every text, with its id.

    The repeated strings of a text start at ``count`` suffixes from each ``first``;
    entries may overlap. ``result`` is the schema of what ``finish`` returns.
    """
    spark = docs.sparkSession
    base, _ = keyed(docs, id_col, text_col)
    runs = base.select("key", "text").mapInArrow(_runs_of(length, gram), RUN)
    order = ["a", "s", "key", "first"]
    settled = runs.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(_settle, "key long, first int, n int, state int")
    lists = settled.groupBy("key").agg(F.collect_list(F.struct("first", "n", "state")).alias("runs"))
    result_type = T._parse_datatype_string(f"struct<{result}>")
    arrow_out = to_arrow_type(result_type)

    def finished(texts: list, firsts: list[np.ndarray], counts: list[np.ndarray]) -> list[dict]:
        return [dict(zip(result_type.names, finish((t or "").encode(), f, c))) for t, f, c in zip(texts, firsts, counts)]

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, fields = _lists(b.column("runs"))
            first, n, state = fields if fields else (np.zeros(0, np.int64),) * 3
            has = [np.add.reduceat(np.append(state == s, False), at[:-1]) * (np.diff(at) > 0) > 0 if len(b) else np.zeros(0, bool) for s in (OPEN, WITNESS)]
            texts, ready = b.column("text").to_pylist(), np.flatnonzero(~has[0])
            rows: list[dict | None] = [None] * len(texts)
            for i, r in zip(ready, finished([texts[i] for i in ready], [first[at[i] : at[i + 1]] for i in ready], [n[at[i] : at[i + 1]] for i in ready])):
                rows[i] = r
            kept = pa.array([t if k else None for t, k in zip(texts, has[0] | has[1])], pa.string())
            yield _batch(["key", "id", "text", "runs", "done", "needed", "opened"], b.column("key"), b.column("id"), kept, b.column("runs"), pa.array(rows, arrow_out), has[0] | has[1], has[0])

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, (first, n, state) = _lists(b.column("runs"))
            to, late = _lists(b.column("late"))
            first_late, n_late = late if late else (np.zeros(0, np.int64),) * 2
            firsts, counts = [], []
            for i in range(len(b)):
                own, more = slice(at[i], at[i + 1]), slice(to[i], to[i + 1])
                known = state[own] != OPEN
                firsts.append(np.concatenate([first[own][known], first_late[more]]))
                counts.append(np.concatenate([n[own][known], n_late[more]]))
            yield _batch(["id", "done"], b.column("id"), pa.array(finished(b.column("text").to_pylist(), firsts, counts), arrow_out))

    joined = base.join(lists, "key", "left").select("key", "id", "text", "runs")
    table = materialise(joined.mapInArrow(first_pass, f"key long, id long, text string, runs array<struct<first:int,n:int,state:int>>, done struct<{result}>, needed boolean, opened boolean"))
    free_shuffles(spark)
    late = _repeated(table.where("needed").select("key", "text", "runs"), length, chunk_bytes)
    rest = table.where("opened").join(late, "key", "left").select("id", "text", "runs", "late").mapInArrow(second_pass, f"id long, done struct<{result}>")
    return table.where("not opened").select("id", "done").unionByName(rest)


def covered(size: int, first: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """Which of ``size`` symbols lie in one of the strings of ``length`` symbols."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + count - 1 + length, -1)
    return np.cumsum(change[:-1]) > 0

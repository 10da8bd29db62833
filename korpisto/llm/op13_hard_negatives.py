"""Operator 13: hard negatives by bit-sliced integer products.

Each component x becomes floor(256 * x). A row's score with an anchor is their
integer inner product. The anchors are a stated set of queries, which every row is
held against in blocks: rows are dealt to parts by a hash, every part gets all
anchors of its dimension, and a task meets them a batch at a time. No key of the
data decides the part, so no label or group of copies makes one heavier.

In a part, rows are tiles of bit planes in two's complement. The planes are
multiplied with the anchors most significant first; what the planes not yet seen can
add lies between ``(2**k - 1)`` times the sum of the anchor's negative and of its
positive components, so every score has an interval that halves with each plane. A
candidate goes as soon as its interval cannot qualify: for positives, if it ends below
the fifth best lower bound; for negatives, if it lies outside every window of the
anchor's positives or ends below the tenth best lower bound in the window. While many
are left, a plane is one matrix product; then only the pairs that are left are
multiplied. The last plane makes the scores exact. What each part keeps of an anchor, at
most five or fifty rows, is merged by rank; nothing is dropped before it.

Defined results: rows with a null label, a null vector, or a null or non-finite
component take no part. Rows of another dimension than the anchor's have no score with
it. Components of more than 2**27 in size count as that, so that scores fit a long.
Equal scores go by the smaller id, null ids last; rows that repeat an id are rows of
their own, and each such anchor has its own result. An anchor without positives, or a
positive without negatives, gives no rows. An empty table gives none; further
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korpisto.llm.common import drop, materialise, shuffle_partitions

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
SCALE, LIMIT = 256, 1 << 27
PART_ROWS, TILE, ANCHORS = 1 << 16, 4096, 128
_LEAST = np.iinfo(np.int64).min // 4
_NO_ID = np.iinfo(np.int64).max


def quantised(vectors: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """Whether each vector is whole and finite, and its components as floor(256 * x), 32 bits each."""
    ok, out = np.zeros(len(vectors), bool), [b""] * len(vectors)
    for k, v in enumerate(vectors):
        if v.is_valid:
            x = v.values
            if x.null_count:
                continue
            x = x.to_numpy(zero_copy_only=False).astype(np.float64)
            if np.isfinite(x).all():
                with np.errstate(over="ignore"):
                    out[k] = np.clip(np.floor(SCALE * x), -LIMIT, LIMIT).astype("<i4").tobytes()
                ok[k] = True
    return ok, out


def _quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok, q = quantised(b.column("v"))
        keep = pa.array(ok)
        cols = [b.column(c).filter(keep) for c in ("key", "id", "label")]
        q = pa.array(q, pa.binary()).filter(keep)
        yield pa.RecordBatch.from_arrays([*cols, q, pa.array([len(x) // 4 for x in q.to_pylist()], pa.int32())], names=["key", "id", "label", "q", "dim"])


# ------------------------------------------------------------------ bit planes
class Tile:
    """Rows of one part with their bit planes."""

    def __init__(self, q: np.ndarray) -> None:
        self.q = q
        self.bits = max(1, int(max(q.max(initial=0), -1 - q.min(initial=0))).bit_length())

    def planes(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(weight, most that the planes after it hold of a one, plane), most significant first."""
        yield -(1 << self.bits), (1 << self.bits) - 1, (self.q < 0)
        for k in range(self.bits - 1, -1, -1):
            yield 1 << k, (1 << k) - 1, (self.q >> k) & 1


def sliced(tile: Tile, anchors: np.ndarray, alive: np.ndarray, prune: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, score) of the pairs that ``prune`` leaves, the scores exact.

    ``alive`` says which pairs are asked. ``prune(low, high, anchor)`` gets the
    score intervals of what is left and says which pairs stay.
    """
    low_sum, high_sum = np.minimum(anchors, 0).sum(1), np.maximum(anchors, 0).sum(1)
    kind = np.float32 if np.abs(anchors).sum(1).max(initial=0) < 1 << 24 else np.float64
    dense, columns = anchors.T.astype(kind), np.arange(len(anchors))[None, :]
    score = np.zeros(alive.shape, np.int64)
    rows = cols = None
    for weight, rest, plane in tile.planes():
        if rows is None:
            score += weight * (plane.astype(kind) @ dense).astype(np.int64)
            alive &= prune(score + rest * low_sum, score + rest * high_sum, np.broadcast_to(columns, score.shape), alive)
            if alive.mean() < 0.05:
                rows, cols = np.nonzero(alive)
                score = score[rows, cols]
        elif len(rows):
            for k in range(0, len(rows), 1 << 16):
                at = slice(k, k + (1 << 16))
                score[at] += weight * np.einsum("ij,ij->i", plane[rows[at]].astype(np.int64), anchors[cols[at]])
            stay = prune(score + rest * low_sum[cols], score + rest * high_sum[cols], cols, None)
            rows, cols, score = rows[stay], cols[stay], score[stay]
    if rows is None:
        rows, cols = np.nonzero(alive)
        score = score[rows, cols]
    return rows, cols, score


def kth_best(values: np.ndarray, k: int) -> np.ndarray:
    """Per column the k-th largest value; the least number where there are fewer."""
    if len(values) < k:
        return np.full(values.shape[1], _LEAST)
    return np.partition(values, len(values) - k, axis=0)[len(values) - k]


class Best:
    """Per (anchor, slot) the first ``count`` rows by score, then id."""

    def __init__(self, count: int, slots: int) -> None:
        self.count, self.floor = count, np.full(slots, _LEAST)
        self.kept = tuple(np.zeros(0, np.int64) for _ in range(4))  # slot, score, id, key

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
        slot, score, ids, keys = (np.concatenate(x) for x in zip(self.kept, (slot, score, ids, keys)))
        order = np.lexsort((keys, ids, -score, slot))
        slot, score, ids, keys = slot[order], score[order], ids[order], keys[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        last = rank == self.count - 1
        self.floor[slot[last]] = score[last]
        stay = rank < self.count
        self.kept = slot[stay], score[stay], ids[stay], keys[stay]


class _Part:
    """The rows of one part, as they arrive before its anchors."""

    def __init__(self, dim: int) -> None:
        self.dim, self.got, self.tiles = dim, [], None

    def add(self, b: pa.RecordBatch) -> None:
        self.got.append(_columns(b, self.dim))

    def ready(self, tile: int) -> list[tuple[Tile, np.ndarray, np.ndarray, np.ndarray]]:
        if self.tiles is None:
            keys, ids, labels, q = (np.concatenate(x) for x in zip(*self.got)) if self.got else _columns(None, self.dim)
            self.tiles = [(Tile(q[k : k + tile]), keys[k : k + tile], ids[k : k + tile], labels[k : k + tile]) for k in range(0, len(keys), tile)]
            self.got = []
        return self.tiles


def _columns(b: pa.RecordBatch | None, dim: int):
    if b is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, dim), np.int64)
    q = np.frombuffer(b"".join(b.column("q").to_pylist()), "<i4").reshape(len(b), dim).astype(np.int64)
    ids = b.column("id").fill_null(_NO_ID)
    return b.column("key").to_numpy(zero_copy_only=False), ids.to_numpy(zero_copy_only=False), b.column("label").to_numpy(zero_copy_only=False), q


def _parts(batches: Iterator[pa.RecordBatch], tile: int) -> Iterator[tuple[list, pa.RecordBatch]]:
    """(tiles of the part, batch of its anchors); the input is sorted by (dim, part, anchor)."""
    part, now = None, None
    for b in batches:
        if not len(b):
            continue
        where = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("dim", "part", "anchor")])
        cut = np.concatenate([[0], np.flatnonzero((where[:, 1:] != where[:, :-1]).any(0)) + 1, [len(b)]])
        for first, end in zip(cut[:-1], cut[1:]):
            dim, number, anchor = (int(x) for x in where[:, first])
            if now != (dim, number):
                part, now = _Part(dim), (dim, number)
            if not anchor:
                part.add(b.slice(first, end - first))
                continue
            tiles = part.ready(tile)
            for k in range(first, end, ANCHORS):
                yield tiles, b.slice(k, min(ANCHORS, end - k))


def _positives(count: int, tile: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tiles, b in _parts(batches, tile):
            keys, _, labels, a = _columns(b, b.column("dim")[0].as_py())
            best = Best(count, len(keys))
            for rows, k, ids, own in tiles:
                alive = (own[:, None] == labels[None, :]) & (k[:, None] != keys[None, :])

                def prune(low, high, col, left):
                    if left is None:
                        return high >= best.floor[col]
                    return high >= np.maximum(best.floor, kth_best(np.where(left, low, _LEAST), count))[None, :]

                r, c, score = sliced(rows, a, alive, prune)
                best.add(c, score, ids[r], k[r])
            slot, score, ids, found = best.kept
            yield pa.RecordBatch.from_arrays([pa.array(keys[slot]), pa.array(score), pa.array(ids), pa.array(found)], names=["anchor_key", "score", "id", "key"])

    return scan


def _negatives(count: int, slots: int, low: int, high: int, tile: int):
    def windows(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Per slot and anchor the least and largest score of a negative; empty where there is no such positive."""
        least, most = np.ones((slots, len(b)), np.int64), np.zeros((slots, len(b)), np.int64)
        for n, scores in enumerate(b.column("scores").to_pylist()):
            for i, p in enumerate(scores):
                least[i, n], most[i, n] = -((-low * p) // 100), (high * p) // 100
        return least, most

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tiles, b in _parts(batches, tile):
            keys, _, labels, a = _columns(b, b.column("dim")[0].as_py())
            least, most = windows(b)
            best = [Best(count, len(keys)) for _ in range(slots)]
            for rows, k, ids, own in tiles:
                alive = (own[:, None] != labels[None, :]) & (least <= most).any(0)[None, :]

                def prune(lower, upper, col, left):
                    stay = np.zeros(lower.shape, bool)
                    for i in range(slots):
                        floor = np.maximum(least[i], best[i].floor)
                        if left is not None:
                            sure = left & (lower >= least[i]) & (upper <= most[i])
                            floor = np.maximum(floor, kth_best(np.where(sure, lower, _LEAST), count))
                        stay |= (upper >= floor[col]) & (lower <= most[i][col])
                    return stay

                r, c, score = sliced(rows, a, alive, prune)
                for i in range(slots):
                    inside = (score >= least[i][c]) & (score <= most[i][c])
                    best[i].add(c[inside], score[inside], ids[r[inside]], k[r[inside]])
            for i in range(slots):
                slot, score, ids, found = best[i].kept
                yield pa.RecordBatch.from_arrays([pa.array(keys[slot]), pa.array(np.full(len(slot), i, np.int32)), pa.array(score), pa.array(ids), pa.array(found)], names=["anchor_key", "place", "score", "id", "key"])

    return scan


# ------------------------------------------------------------------ operator
def _dealt(rows: DataFrame, anchors: DataFrame, parts: int, tasks: int, *more: str) -> DataFrame:
    """Rows by part, then every part's anchors."""
    part = F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")
    own = rows.select("key", "id", "label", "q", "dim", part.alias("part"), F.lit(0).alias("anchor"), *(F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in more))
    asked = anchors.select("key", "id", "label", "q", "dim", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("anchor"), *more)
    return own.unionByName(asked).repartition(tasks, "dim", "part").sortWithinPartitions("dim", "part", "anchor")


def hard_negatives(
    rows: DataFrame, *, is_anchor: str, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, part_rows: int = PART_ROWS, tile: int = TILE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is an SQL condition on ``id``. The positives of an anchor are its
    first ``positives`` other rows of its label; the negatives of a positive are the
    first ``negatives`` rows of other labels whose score is ``low`` to ``high`` percent of
    the positive's.
    """
    spark = rows.sparkSession
    base = rows.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"))
    table = materialise(base.where("label is not null and v is not null").mapInArrow(_quantise, "key long, id long, label long, q binary, dim int"))
    tasks = shuffle_partitions(spark)
    parts = max(tasks, -(-table.count() // part_rows))
    tasks = max(tasks, parts)
    anchors = table.where(f"coalesce({is_anchor}, false)")

    real_id = F.when(F.col("id") < _NO_ID, F.col("id")).alias("id")
    first = Window.partitionBy("anchor_key").orderBy(F.desc("score"), "id", "key")
    near = _dealt(table, anchors, parts, tasks).mapInArrow(_positives(positives, tile), "anchor_key long, score long, id long, key long")
    near = near.withColumn("place", F.row_number().over(first) - 1).where(F.col("place") < positives)
    near = materialise(near.select("anchor_key", "place", "score", real_id))
    scores = near.groupBy("anchor_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda s: s["score"]).alias("scores"))
    asked = anchors.join(scores.withColumnRenamed("anchor_key", "key"), "key")
    first = Window.partitionBy("anchor_key", "place").orderBy(F.desc("score"), "id", "key")
    far = _dealt(table, asked, parts, tasks, "scores").mapInArrow(_negatives(negatives, positives, low, high, tile), "anchor_key long, place int, score long, id long, key long")
    far = far.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)
    far = materialise(far.select("anchor_key", "place", "rank", F.col("score").alias("negative_score"), real_id.alias("negative_id")))
    anchor_ids = materialise(anchors.select(F.col("key").alias("anchor_key"), F.col("id").alias("anchor_id")))
    drop(table)
    near = near.select("anchor_key", "place", F.col("score").alias("positive_score"), F.col("id").alias("positive_id"))
    return far.join(near, ["anchor_key", "place"]).join(anchor_ids, "anchor_key").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

"""Operator 10: quality rules with an isolation forest.

Rule statistics of every document come from one pass over its text. A forest of
random splits counts all labelled rows of good quality; a split falls anywhere in
its node's box, and the first box spans the good and the bad rows alike. A node
that holds no more than one in ``points`` of the good rows is not split. Where no
good row lies, a box is soon empty and its path ends: the shorter a document's
mean path, the odder its statistics, and that alone makes the score. The score
above which a document goes is calibrated on all labelled rows, the good ones
without their own count: of the thresholds that cost at most ``spare`` of the good
ones, the one that parts good from bad the best.

Splits depend on the box alone, so trees are drawn whole, and counts of their
leaves and of the scores, which have 16 bits, are Spark's sums over all labelled
rows. What reaches the driver is bounded by trees and points. With fewer than 8
good labelled rows the base rules decide alone; without bad ones the threshold
follows ``spare``.

Null and empty texts have no words and fail the base rule of 20 words. Very long
texts are read whole. Ids may be null or repeat: each row is judged by its own
text, and repeated rows get the same verdict. An empty table gives no rows. Of
further columns, whatever their names, none is read. Repeated windows and lines
are compared by hashes modulo a prime of 61 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpisto.llm.common import BYTE_CODE, U64, WHITE, drop, materialise, mix, prefix, spans, text_chunks, words_of

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks")
FEATURES = 6
_BYTES = np.arange(256)
_SYMBOL = np.isin(_BYTES, list(b"#*$%&|<>"))
_MARK = (_BYTES > 32) & (_BYTES < 127) & ~np.isin(_BYTES, list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
_POINT = (_BYTES & 0xC0) != 0x80
WINDOW = 8
GRID = 1 << 16


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets])


def _distinct(key: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    _, first = np.unique(key, return_index=True)
    return np.bincount(doc[first], minlength=docs)


def statistics(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """STATS of the texts that ``offsets`` cut ``data`` into."""
    docs = len(offsets) - 1
    inside = ~WHITE[data]
    starts, ends, doc = words_of(data, offsets)
    n_words = np.bincount(doc, minlength=docs)
    p = prefix(BYTE_CODE[data])
    # lines
    line_start = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], np.flatnonzero(data[:-1] == 10) + 1])) if len(data) else np.zeros(0, np.int64)
    line_end = np.concatenate([line_start[1:], [len(data)]]).astype(np.int64) if len(line_start) else line_start
    closed = data[line_end - 1] == 10 if len(line_start) else np.zeros(0, bool)
    line_end = line_end - closed
    line_doc = np.searchsorted(offsets, line_start, "right") - 1
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=total[1:])
    wordy = total[line_end] > total[line_start]
    ls, le, ld = line_start[wordy], line_end[wordy], line_doc[wordy]
    salt = mix(np.arange(docs, dtype=U64) + U64(1))
    dup = np.bincount(ld, minlength=docs) - _distinct(mix(spans(p, ls, le) + salt[ld]), ld, docs)
    # windows of words
    code = spans(p, starts, ends)
    q = prefix(code)
    at = np.arange(len(code) - WINDOW + 1) if len(code) >= WINDOW else np.zeros(0, np.int64)
    at = at[doc[at] == doc[at + WINDOW - 1]] if len(at) else at
    key = mix(spans(q, at, at + WINDOW) + salt[doc[at]])
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(at) + 1, bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    twice = at[order[same[1:] | same[:-1]]]
    change = np.bincount(twice, minlength=len(code) + 1) - np.bincount(twice + WINDOW, minlength=len(code) + 1) if len(twice) else np.zeros(len(code) + 1, np.int64)
    covered = np.cumsum(change)[: len(code)] > 0
    repeat = np.bincount(doc[covered], minlength=docs)
    point = _POINT[data]
    return [n_words, _per_doc(point & inside, offsets), _per_doc(_SYMBOL[data], offsets), dup, repeat, _per_doc(_MARK[data], offsets)]


def rule_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, data, offsets in text_chunks(b.column(1)):
                stats = statistics(data, offsets)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, last - first), *(pa.array(np.asarray(s, np.int64)) for s in stats)], names=["doc_id", *STATS])

    source = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return source.mapInArrow(scan, "doc_id long, " + ", ".join(f"{s} long" for s in STATS))


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Rates that do not depend on a document's length, in bounded ranges. n x FEATURES"""
    s = {k: np.asarray(v, float) for k, v in stats.items()}
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    out = [
        np.minimum(s["word_chars"] / words, 20), np.minimum(s["n_symbols"] / words, 4), s["n_symbols"] / chars,
        s["n_repeat_words"] / words, np.minimum(s["n_marks"] / words, 6), s["n_dup_lines"] / (s["n_dup_lines"] + 16),
    ]
    return np.stack(out, 1)


# ------------------------------------------------------------- isolation forest
def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def drawn(box: tuple[np.ndarray, np.ndarray], trees: int, deepest: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features (-1 where a box has no width) and splits of whole trees, node k before 2k + 1 and 2k + 2. trees x (2 ** deepest - 1)"""
    rng = np.random.default_rng(seed)
    feature, split = np.full((trees, (1 << deepest) - 1), -1, np.int8), np.zeros((trees, (1 << deepest) - 1))
    for tree in range(trees):
        low, high = box[0][None, :], box[1][None, :]
        for d in range(deepest):
            here = slice((1 << d) - 1, (2 << d) - 1)
            pick = np.argmax(np.where(high > low, rng.random(low.shape), -1.0), 1)
            rows = np.arange(1 << d)
            at = low[rows, pick] + rng.random(1 << d) * (high[rows, pick] - low[rows, pick])
            feature[tree, here], split[tree, here] = np.where(high[rows, pick] > low[rows, pick], pick, -1), at
            low, high = np.repeat(low, 2, 0), np.repeat(high, 2, 0)
            high[2 * rows, pick] = low[2 * rows + 1, pick] = at
    return feature, split


def leaf_counts(trees: tuple[np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    """How many rows fall into each leaf of the whole trees. trees x 2 ** deepest"""
    feature, split = trees
    leaves = feature.shape[1] + 1
    out, every = np.zeros((len(feature), leaves), np.int64), np.arange(len(x))
    for tree in range(len(feature)):
        node = np.zeros(len(x), np.int64)
        for _ in range(leaves.bit_length() - 1):
            f = feature[tree, node]
            node = 2 * node + 1 + ((f >= 0) & (x[every, np.maximum(f, 0)] > split[tree, node]))
        out[tree] = np.bincount(node - leaves + 1, minlength=leaves)
    return out


def deepest_of(points: int, rows: int) -> int:
    return int(np.ceil(np.log2(max(2, min(points, rows))))) + 4


def built(trees: tuple[np.ndarray, np.ndarray], counts: np.ndarray, points: int, less: int = 0) -> dict[str, np.ndarray]:
    """Trees as arrays: feature (-1 at leaves), split, left child (right = left + 1), path length at leaves.

    ``counts`` are those of the leaves; a node with at most one in ``points`` of the rows is a
    leaf, and what a leaf holds counts as among ``points`` rows. With ``less``, each node is
    taken to hold so many fewer: how the trees judge a row that they have counted themselves.
    """
    levels = [counts]
    while levels[-1].shape[1] > 1:
        levels.append(levels[-1][:, ::2] + levels[-1][:, 1::2])
    rows = max(1, int(levels[-1][0, 0]) - less)
    share, scale = max(1.0, rows / points), min(1.0, points / rows)
    tree, place, columns, total = np.arange(len(counts)), np.zeros(len(counts), np.int64), [], 0
    for depth, level in enumerate(reversed(levels)):
        held, node = np.maximum(level[tree, place] - less, 0), np.minimum((1 << depth) - 1 + place, trees[0].shape[1] - 1)
        inner = (held > share) & (trees[0][tree, node] >= 0) & (depth < len(levels) - 1)
        total += len(tree)
        left = np.where(inner, total + 2 * (np.cumsum(inner) - 1), 0)
        columns.append((np.where(inner, trees[0][tree, node], -1), np.where(inner, trees[1][tree, node], 0.0), left, np.where(inner, 0.0, depth + average_path(held * scale))))
        tree, place = np.repeat(tree[inner], 2), np.repeat(2 * place[inner], 2)
        place[1::2] += 1
    feature, split, left, path = map(np.concatenate, zip(*columns))
    return {"feature": feature.astype(np.int64), "split": split, "left": left, "path": path, "roots": np.arange(len(counts)), "norm": average_path(min(points, rows))}


def grow(x: np.ndarray, box: tuple[np.ndarray, np.ndarray], trees: int, points: int, seed: int) -> dict[str, np.ndarray]:
    """The forest of rows at hand, as ``fit`` has it from sums over a table."""
    whole = drawn(box, trees, deepest_of(points, len(x)), seed)
    return built(whole, leaf_counts(whole, x), points)


def anomaly(forest: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """2 ** (-mean path length / normal length), in (0, 1]; high is odd."""
    total = np.zeros(len(x))
    every = np.arange(len(x))
    for root in forest["roots"]:
        node = np.full(len(x), root)
        while True:
            f = forest["feature"][node]
            inner = f >= 0
            if not inner.any():
                break
            go = forest["left"][node] + (x[every, np.maximum(f, 0)] > forest["split"][node])
            node = np.where(inner, go, node)
        total += forest["path"][node]
    return 2.0 ** (-total / len(forest["roots"]) / max(float(forest["norm"]), 1e-9))


def scores(forest: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """``anomaly`` in whole steps of 1 / GRID."""
    return np.rint(anomaly(forest, x) * GRID).astype(np.int64)


def threshold_of_counts(values: np.ndarray, good: np.ndarray, bad: np.ndarray, spare: float) -> float:
    """``threshold_of`` from the ascending distinct scores and how many good and bad rows have each."""
    below_good, below_bad = np.cumsum(good), np.cumsum(bad)
    rows = int(below_good[-1])
    least = int(np.searchsorted(below_good, int(np.ceil((1 - spare) * (rows - 1) - 1e-9)), "right"))
    caught, lost = 1 - below_bad / max(int(below_bad[-1]), 1), 1 - below_good / rows
    return float(values[least + (int(np.argmax((caught - lost / spare * 0.1)[least:])) if below_bad[-1] else 0)])


def threshold_of(good: np.ndarray, bad: np.ndarray, spare: float) -> float:
    """The score that at most ``spare`` of the good ones exceed and that parts good from bad the best."""
    values, place = np.unique(np.concatenate([good, bad]), return_inverse=True)
    return threshold_of_counts(values, np.bincount(place[: len(good)], minlength=len(values)), np.bincount(place[len(good) :], minlength=len(values)), spare)


def _columns(b: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {s: b.column(b.schema.get_field_index(s)).to_numpy(zero_copy_only=False) for s in STATS}


def _fit(stats: DataFrame, labelled: DataFrame, *, trees: int, points: int, spare: float, seed: int) -> tuple[dict | None, float]:
    """``fit`` from ``rule_statistics``."""
    marks = labelled.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") > 0).alias("good"))
    rows = materialise(stats.join(marks, "doc_id").where("n_words >= 20 and 100 * n_repeat_words <= 30 * n_words").select(*STATS, "good"))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x = features(_columns(b))
                good = int(b.column(b.num_columns - 1).to_numpy(zero_copy_only=False).sum())
                yield pa.RecordBatch.from_arrays([pa.array([float(v)]) for v in (*x.min(0), *x.max(0))] + [pa.array([good], pa.int64())], names=[*names, "n"])

    names = [f"{e}{k}" for e in ("low", "high") for k in range(FEATURES)]
    box = rows.mapInArrow(edges, ", ".join(f"{c} double" for c in names) + ", n long").agg(*[F.min(c) for c in names[:FEATURES]], *[F.max(c) for c in names[FEATURES:]], F.sum("n")).first()
    total = box[-1] or 0
    if total < 8:
        drop(rows)
        return None, float("inf")
    whole = drawn((np.array(box[:FEATURES]), np.array(box[FEATURES:-1])), trees, deepest_of(points, total), seed)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((trees, whole[0].shape[1] + 1), np.int64)
        for b in batches:
            held += leaf_counts(whole, features(_columns(b))[b.column(b.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)])
        cell = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(held.ravel()[cell])], names=["cell", "n"])

    found = rows.mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # as many rows as leaves, at most
    counts = np.zeros((trees, whole[0].shape[1] + 1), np.int64)
    counts.ravel()[found.cell.to_numpy()] = found.n.to_numpy()
    forest, others = built(whole, counts, points), built(whole, counts, points, 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, good = features(_columns(b)), b.column(b.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            told = np.where(good, scores(others, x), scores(forest, x)) if len(b) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(told), pa.array(good)], names=["score", "good"])

    one = lambda good: F.sum(F.when(F.col("good") == good, 1).otherwise(0))
    told = rows.mapInArrow(score, "score long, good boolean").groupBy("score").agg(one(True).alias("good"), one(False).alias("bad")).toPandas().sort_values("score")  # GRID rows at most
    drop(rows)
    return forest, threshold_of_counts(told.score.to_numpy() / GRID, told.good.to_numpy(), told.bad.to_numpy(), spare)


def fit(docs: DataFrame, labelled: DataFrame, *, sample: int | None = None, trees: int, points: int, spare: float, seed: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[dict | None, float]:
    """The forest and the threshold, from all labelled rows; ``sample`` is for trials, which may do with so many ids."""
    if sample is not None:
        labelled = labelled.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample)
    return _fit(rule_statistics(docs, id_col=id_col, text_col=text_col), labelled, trees=trees, points=points, spare=spare, seed=seed)


def _judged(s: dict[str, np.ndarray], forest: dict | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anomaly, base_failed, kept) from statistics."""
    failed = (s["n_words"] < 20) | (100 * s["n_repeat_words"] > 30 * s["n_words"])
    odd = scores(forest, features(s)) / GRID if forest and len(failed) else np.zeros(len(failed))
    return odd, failed, ~failed & (odd <= threshold)


def judge(
    docs: DataFrame,
    labelled: DataFrame,
    *,
    trees: int = 128,
    points: int = 256,
    spare: float = 0.005,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, n_words, the base statistics, anomaly, base_failed, kept.

    ``labelled`` has doc_id and quality (1 good, 0 bad).
    """
    stats = materialise(rule_statistics(docs, id_col=id_col, text_col=text_col))  # texts are read once
    forest, threshold = _fit(stats, labelled, trees=trees, points=points, spare=spare, seed=seed)
    columns = ["doc_id", *STATS[:5], "anomaly", "base_failed", "kept"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:6], *map(pa.array, _judged(_columns(b), forest, threshold))], names=columns)

    schema = "doc_id long, " + ", ".join(f"{s} long" for s in STATS[:5]) + ", anomaly double, base_failed boolean, kept boolean"
    return stats.mapInArrow(score, schema)


def keep(
    docs: DataFrame,
    labelled: DataFrame,
    *,
    trees: int = 128,
    points: int = 256,
    spare: float = 0.005,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows that ``judge`` keeps, all columns as they are."""
    forest, threshold = fit(docs, labelled, trees=trees, points=points, spare=spare, seed=seed, id_col=id_col, text_col=text_col)
    where = docs.columns.index(text_col)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, data, offsets in text_chunks(b.column(where)):
                s = dict(zip(STATS, statistics(data, offsets)))
                yield b.slice(first, last - first).filter(pa.array(_judged(s, forest, threshold)[2]))

    return docs.mapInArrow(choose, docs.schema)

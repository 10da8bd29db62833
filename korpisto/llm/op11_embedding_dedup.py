"""Operator 11: near-duplicate embeddings by a pivot-permutation index.

Reference points (pivots) come from a sample in the order of a hash, thinned so that no
two are much alike; there are about four times the square root of the number of rows,
``MOST_PIVOTS`` and two million components at most, from four times as many rows. Every vector is
described by its ``NEAREST`` nearest pivots in order.

1. Balls. The vectors are dealt by their first pivot, and within it by a hash to
   blocks of about ``BLOCK`` rows, so a pivot that a third of all rows share is many
   blocks. In a block, vectors within half of the link angle of a common centre form
   a ball: any two of them are linked by the triangle inequality, so copies and dense
   groups, equal vectors foremost, count their links without a pair being made. Balls
   of different blocks merge in further rounds, as long as that makes fewer.
2. Inverted lists. A ball is posted under each pair of pivots that one of its vectors
   has among its nearest, so two vectors meet in a list if and only if they share two
   pivots at least. A posting carries the ball's centre in bytes and its radius. A
   long list is cut into squares of at most ``LIST`` balls a side; in each only those
   pairs are told whose centres are near enough, quantisation allowed for, that
   members could be linked.
3. Verification in double precision, on the members' own vectors: pairs of chunks of at
   most ``BLOCK`` members. Counts and one edge leave it, never pairs of members.
4. Components from minimum labels over the balls.

Links found are exact; one is missed only where two vectors share fewer than two of
their nearest pivots. Two unit vectors of random direction with a cosine of 0.95
are found with a chance of 0.998, at 0.97 with 0.9999; ``test_embedding_dedup`` measures it.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing. Vectors of different dimension don't link. Null ids
and ids that repeat are rows of their own; a component has the smallest id that
is not null. Components have no bound on size. An empty table gives no rows;
further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpisto.llm.common import drop, materialise, shuffle_partitions, told
from korpisto.llm.op06_near_dedup import components

MOST_PIVOTS, NEAREST, ALIKE = 1 << 14, 8, 0.8
BLOCK, LIST = 2048, 256
_SLACK = 1e-9


def units(vectors: pa.Array) -> list[np.ndarray | None]:
    """Each vector at unit length in double precision; None where it can't have one."""
    out: list[np.ndarray | None] = []
    for v in vectors:
        x = v.values if v.is_valid else None
        unit = None
        if x is not None and len(x) and not x.null_count:
            x = x.to_numpy(zero_copy_only=False).astype(np.float64)
            most = np.abs(x).max()
            if np.isfinite(most) and most > 0:
                x = x / most  # neither overflow nor underflow
                unit = x / np.sqrt((x * x).sum())
        out.append(unit)
    return out


def _normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = units(b.column("v"))
        q = pa.array([None if u is None else u.astype("<f8").tobytes() for u in found], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("id"), q, pa.array([0 if u is None else len(u) for u in found], pa.int32())], names=["key", "id", "q", "dim"])


def _matrix(column: pa.Array, kind: str = "<f8") -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1) if rows else np.zeros((0, 0))


# ---------------------------------------------------------------------- pivots
def pivots(table: DataFrame, most: int = MOST_PIVOTS) -> dict[int, np.ndarray]:
    """By dimension, reference points from a bounded sample, no two much alike."""
    rows, wide = table.agg(F.count("*"), F.max("dim")).first()
    want = int(min(most, max(16, 4 * rows**0.5), max(16, (1 << 21) // (wide or 1))))
    sample = table.select("dim", "q").orderBy(F.xxhash64("key")).limit(4 * want).toPandas()
    out = {}
    for dim, group in sample.groupby("dim"):
        m = np.frombuffer(b"".join(group["q"]), "<f8").reshape(-1, dim)
        chosen = np.zeros((0, dim))
        for k in range(0, len(m), 256):
            new = m[k : k + 256]
            new = new[(new @ chosen.T).max(1, initial=-1) < ALIKE]
            near = np.tril(new @ new.T, -1).max(1, initial=-1) < ALIKE
            chosen = np.concatenate([chosen, new[near]])[:want]
        out[int(dim)] = np.ascontiguousarray(chosen)
    return out


def _points(by_dim: dict[int, np.ndarray], dim: int) -> np.ndarray:
    """A dimension that the sample has missed has one pivot, and so one list that is cut into squares."""
    return by_dim.get(dim, np.zeros((1, dim)))


def nearest(m: np.ndarray, points: np.ndarray, count: int) -> np.ndarray:
    """The nearest pivots of each row, nearest first; equally near ones by number."""
    count, out = min(count, len(points)), []
    for k in range(0, len(m), 512):
        s = m[k : k + 512] @ points.T
        top = np.sort(np.argpartition(-s, count - 1, axis=1)[:, :count], axis=1)
        out.append(np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out) if out else np.zeros((0, count), np.int64)


def pivot_pairs(near: np.ndarray, dim: int, points: int) -> np.ndarray:
    """Keys of the pairs among each row's nearest pivots, and of the only pivot where there is but one."""
    if near.shape[1] < 2:
        return near.astype(np.int64) * 0 + dim
    near = np.sort(near, axis=1).astype(np.int64)
    a, b = np.triu_indices(near.shape[1], 1)
    return (near[:, a] * points + near[:, b]) * 4096 + dim % 4096


def _first_pivot(by_dim, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        dims, first = b.column("dim").to_numpy(zero_copy_only=False), np.zeros(len(b), np.int32)
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            first[at] = nearest(_matrix(b.column("q").take(pa.array(at))), _points(by_dim, int(dim)), 1)[:, 0]
        yield b.append_column("first", pa.array(first))


# ----------------------------------------------------------------------- balls
def gathered(m: np.ndarray, radius: np.ndarray, most: float) -> np.ndarray:
    """Per row its leader: a row whose ball of angle ``most`` holds the whole of the row's own ball."""
    leader = np.full(len(m), -1)
    order = np.arange(len(m))
    limit = np.cos(np.maximum(most - radius, 0)) + _SLACK
    limit[radius > most] = 2
    while len(order):
        head, rest = order[:128], order[128:]
        inside = m[head] @ m[head].T >= limit[head][None, :]
        taken = np.zeros(len(head), bool)
        for k in range(len(head)):
            if not taken[k]:
                own = inside[k] & ~taken
                own[k] = True
                leader[head[own]] = head[k]
                taken |= own
        if len(rest):
            leads = head[leader[head] == head]
            s = m[rest] @ m[leads].T
            best = s.argmax(1)
            ok = s[np.arange(len(rest)), best] >= limit[rest]
            leader[rest[ok]] = leads[best[ok]]
            rest = rest[~ok]
        order = rest
    return leader


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine - 1e-12, -1, 1))


def _blocks(most: float):
    """Rows (key, q, radius) of a block to (key, ball, centre, radius of the ball)."""

    def gather(table: pa.Table) -> pa.Table:
        key, m, radius = table.column("key").to_numpy(), _matrix(table.column("q").combine_chunks()), table.column("radius").to_numpy()
        order = np.argsort(key)
        key, m, radius = key[order], m[order], radius[order]
        leader = gathered(m, radius, most)
        heads, ball = np.unique(leader, return_inverse=True)
        mean = np.zeros((len(heads), m.shape[1]))
        np.add.at(mean, ball, m)
        mean /= np.sqrt((mean * mean).sum(1, keepdims=True))  # not zero: members are within half the link angle
        wide = np.zeros((2, len(heads)))
        for n, centre in enumerate((m[heads], mean)):
            np.maximum.at(wide[n], ball, _angle((m * centre[ball]).sum(1)) + radius)
        centre = np.where((wide[1] < wide[0])[:, None], mean, m[heads])
        alone = np.bincount(ball) == 1
        centre[alone], reach = m[heads[alone]], np.where(alone, radius[heads], wide.min(0))
        return pa.table({
            "key": pa.array(key), "ball": pa.array(key[heads][ball]), "centre": pa.array([x.tobytes() for x in centre[ball]], pa.binary()),
            "wide": pa.array(reach[ball]), "dim": pa.array(np.full(len(key), m.shape[1], np.int32)),
        })

    return gather


def _round(rows: DataFrame, by_dim, most: float, block: int) -> DataFrame:
    """One round of balls over (key, q, dim, radius): (key, ball, centre, wide, dim), one row per key."""
    dealt = rows.mapInArrow(lambda it: _first_pivot(by_dim, it), "key long, q binary, dim int, radius double, first int")
    dealt = materialise(dealt)
    sizes = dealt.groupBy("dim", "first").count()  # as many rows as pivots
    blocks = dealt.join(F.broadcast(sizes), ["dim", "first"]).withColumn("block", F.pmod(F.xxhash64("key"), F.ceil(F.col("count") / block)))
    out = materialise(blocks.select("key", "q", "radius", "dim", "first", "block").groupBy("dim", "first", "block").applyInArrow(_blocks(most), "key long, ball long, centre binary, wide double, dim int"))
    drop(dealt)
    return out


# -------------------------------------------------------------- inverted lists
def _postings(by_dim, count: int):
    """(list, ball) of every vector's pairs of pivots."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, ball = b.column("dim").to_numpy(zero_copy_only=False), b.column("ball").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                points = _points(by_dim, int(dim))
                keys = pivot_pairs(nearest(_matrix(b.column("q").take(pa.array(at))), points, count), int(dim), len(points))
                both = np.unique(np.stack([np.repeat(ball[at], keys.shape[1]), keys.reshape(-1)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[1]), pa.array(both[0])], names=["list", "ball"])

    return scan


def _in_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Centres with components in steps of 1/127."""
    for b in batches:
        small = [np.round(np.frombuffer(c, "<f8") * 127).astype(np.int8).tobytes() for c in b.column("centre").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("ball"), pa.array(small, pa.binary()), b.column("wide"), b.column("dim")], names=["ball", "small", "wide", "dim"])


def _pairs_within(group: np.ndarray, side: np.ndarray, two_sided: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs in each group: of its two sides, or else all. Sorted by (group, side)."""
    n = np.arange(len(group))
    end = np.searchsorted(group, group, "right")
    middle = np.searchsorted(group * 2 + side, group * 2 + 1)
    first = np.where(two_sided, np.where(side == 0, middle, end), n + 1)
    many = end - first
    a = np.repeat(n, many)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)


def _near_pairs(link: float):
    """Pairs of a list's square whose centres, by their bytes, may be near enough. Sorted by (dim, list, low, high, side).

    The rounding of a component is at most 1/254, so a product of two centres is off
    by at most sqrt(dim) / 127 + dim / 254**2.
    """

    def told(t: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        dims = t.column("dim").to_numpy()
        for dim in np.unique(dims):
            at = dims == dim
            rows = t.filter(pa.array(at))
            m = _matrix(rows.column("small").combine_chunks(), "i1")
            side, ball, wide, low, high = (rows.column(c).to_numpy() for c in ("side", "ball", "wide", "low", "high"))
            a, b = _pairs_within(group[at], side.astype(np.int64), low < high)
            off = m.shape[1] ** 0.5 / 127 + m.shape[1] / 254**2
            for k in range(0, len(a), 1 << 15):
                x, y = a[k : k + (1 << 15)], b[k : k + (1 << 15)]
                cosine = np.einsum("ij,ij->i", m[x].astype(np.float32), m[y].astype(np.float32)) / 127**2 + off
                ok = (cosine >= np.cos(np.minimum(link + wide[x] + wide[y], np.pi)) - 1e-6) & (ball[x] != ball[y])
                if ok.any():
                    p, q = ball[x[ok]], ball[y[ok]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], names=["a", "b"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the last square, which may go on in the next batch
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if not len(t):
                continue
            where = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("dim", "list", "low", "high")])
            group = np.concatenate([[0], np.cumsum((where[:, 1:] != where[:, :-1]).any(0))])
            cut = int(np.searchsorted(group, group[-1]))
            yield from told(t.slice(0, cut), group[:cut])
            held = t.slice(cut).combine_chunks()
        if held is not None and len(held):
            yield from told(held, np.zeros(len(held), np.int64))

    return scan


def _meetings(members: DataFrame, balls: DataFrame, by_dim, link: float, count: int, size: int) -> DataFrame:
    """(a, b): pairs of balls that share a list and whose centres may be near enough."""
    parts = shuffle_partitions(members.sparkSession)
    posted = materialise(members.select("ball", "q", "dim").mapInArrow(_postings(by_dim, count), "list long, ball long").distinct())
    lengths = posted.groupBy("list").agg(F.count("*").alias("length")).where("length > 1")
    small = balls.select("ball", "centre", "wide", "dim").mapInArrow(_in_bytes, "ball long, small binary, wide double, dim int")
    rows = told(posted, lengths, "list", "ball").withColumn("squares", F.ceil(F.col("length") / size).cast("long"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("ball"), F.col("squares"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("squares") - 1)))
    rows = rows.select("list", "ball", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    squares = rows.join(small, "ball").select("dim", "list", "low", "high", "side", "ball", "small", "wide")
    keys = ["dim", "list", "low", "high"]
    return squares.repartition(parts, *keys).sortWithinPartitions(*keys, "side").mapInArrow(_near_pairs(link), "a long, b long").distinct()


# ---------------------------------------------------------------- verification
def _judged(least: float, link: float):
    """Per pair of chunks whether all, some or none of their members are linked, as far as their centres tell."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            ok = np.zeros(len(b), np.int8)
            na, nb, wa, wb = (b.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb", "wa", "wb"))
            ca, cb = b.column("ca").to_pylist(), b.column("cb").to_pylist()
            cosine = np.array([np.frombuffer(x, "<f8") @ np.frombuffer(y, "<f8") if len(x) == len(y) else -1.0 for x, y in zip(ca, cb)])
            single = (na == 1) & (nb == 1)
            angle = np.arccos(np.clip(cosine, -1, 1))
            ok[~single & (angle <= link + wa + wb + 1e-6)] = 1
            ok[np.where(single, cosine >= least, angle + wa + wb <= link - 1e-6)] = 2
            keep = pa.array(ok > 0)
            rest = [b.column(c).filter(keep) for c in ("x", "y", "a", "b", "na", "nb")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(ok[ok > 0] == 2)], names=["x", "y", "a", "b", "na", "nb", "sure"])

    return scan


def _counted(least: float):
    """Of two chunks' members: links by member, and whether there is any."""

    def count(t: pa.Table) -> pa.Table:
        side, key, m = t.column("side").to_numpy(), t.column("key").to_numpy(), _matrix(t.column("q").combine_chunks())
        p, q = m[side == 0], m[side == 1]
        rows, cols = np.zeros(len(p), np.int64), np.zeros(len(q), np.int64)
        for k in range(0, len(p), 512):
            linked = p[k : k + 512] @ q.T >= least
            rows[k : k + 512] = linked.sum(1)
            cols += linked.sum(0)
        keys, links = np.concatenate([key[side == 0], key[side == 1]]), np.concatenate([rows, cols])
        keys, links = keys[links > 0], links[links > 0]
        return pa.table({"key": pa.array(keys), "links": pa.array(links), "a": t.column("a").slice(0, 1).take(pa.array(np.zeros(len(keys), np.int64))), "b": t.column("b").slice(0, 1).take(pa.array(np.zeros(len(keys), np.int64)))})

    return count


def links_and_components(base: DataFrame, *, least: float, nearest_pivots: int, block: int, size: int, most_pivots: int) -> DataFrame:
    """(key, links, low): links of each row, and the smallest id in its component. ``base`` has key, id, q, dim."""
    link = float(np.arccos(least))
    most = link / 2 - 1e-7
    by_dim = pivots(base, most_pivots)
    chunks = _round(base.select("key", "q", "dim", F.lit(0.0).alias("radius")), by_dim, most, block)
    heads = chunks.where("key = ball").select(F.col("ball").alias("key"), F.col("centre").alias("q"), "dim", F.col("wide").alias("radius"))
    count, final, tables = heads.count(), heads.select(F.col("key").alias("chunk"), F.col("key").alias("ball"), F.col("q").alias("centre"), F.col("radius").alias("wide"), "dim"), [chunks]
    while True:
        merged = _round(heads, by_dim, most, block)
        heads = merged.where("key = ball").select(F.col("ball").alias("key"), F.col("centre").alias("q"), "dim", F.col("wide").alias("radius"))
        fewer = heads.count()
        step = merged.select(F.col("key").alias("ball"), F.col("ball").alias("next"), F.col("centre").alias("c"), F.col("wide").alias("w"))
        final = materialise(final.join(step, "ball").select("chunk", F.col("next").alias("ball"), F.col("c").alias("centre"), F.col("w").alias("wide"), "dim"))
        tables += [merged, final]
        if fewer >= 0.9 * count:
            break
        count = fewer

    members = materialise(base.join(chunks.select("key", F.col("ball").alias("chunk"), F.col("centre").alias("cc"), F.col("wide").alias("cw")), "key").join(final.select("chunk", "ball"), "chunk"))
    balls = final.groupBy("ball").agg(F.first("centre").alias("centre"), F.first("wide").alias("wide"), F.first("dim").alias("dim"))
    met = materialise(_meetings(members, balls, by_dim, link, nearest_pivots, size))
    parts = materialise(members.groupBy("chunk", "ball").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.first("cc").alias("c"), F.first("cw").alias("w")))
    one = parts.select(F.col("ball").alias("a"), F.col("chunk").alias("x"), F.col("c").alias("ca"), F.col("w").alias("wa"), F.col("n").alias("na"))
    two = parts.select(F.col("ball").alias("b"), F.col("chunk").alias("y"), F.col("c").alias("cb"), F.col("w").alias("wb"), F.col("n").alias("nb"))
    judged = materialise(met.join(one, "a").join(two, "b").mapInArrow(_judged(least, link), "x long, y long, a long, b long, na long, nb long, sure boolean"))
    open_ = judged.where("not sure")
    sides = [open_.select("x", "y", "a", "b", F.lit(k).alias("side"), F.col(c).alias("chunk")).join(members.select("chunk", "key", "q"), "chunk") for k, c in enumerate("xy")]
    checked = materialise(sides[0].union(sides[1]).groupBy("x", "y").applyInArrow(_counted(least), "key long, links long, a long, b long"))
    edges = judged.where("sure").select("a", "b").union(checked.select("a", "b")).distinct()
    labels = components(edges)

    sure = judged.where("sure")
    by_chunk = sure.select(F.col("x").alias("chunk"), F.col("nb").alias("more")).union(sure.select(F.col("y").alias("chunk"), F.col("na").alias("more"))).groupBy("chunk").agg(F.sum("more").alias("more"))
    by_ball = parts.groupBy("ball").agg(F.sum("n").alias("size"), F.min("low").alias("low")).join(labels.withColumnRenamed("key", "ball"), "ball", "left").withColumn("label", F.coalesce("label", "ball"))
    by_ball = materialise(by_ball)
    lowest = by_ball.groupBy("label").agg(F.min("low").alias("lowest"))
    by_ball = told(by_ball, lowest, "label", "ball").select("ball", "size", "lowest")
    by_chunk = told(parts.select("chunk", "ball"), by_ball, "ball", "chunk").join(by_chunk, "chunk", "left").select("chunk", (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("sure"), "lowest")
    own = checked.groupBy("key").agg(F.sum("links").alias("own"))
    out = members.select("key", "chunk").join(by_chunk, "chunk").join(own, "key", "left").select("key", (F.col("sure") + F.coalesce("own", F.lit(0))).alias("links"), "lowest")
    out = materialise(out)
    for t in (*tables, members, met, parts, judged, checked, labels):
        drop(t)
    return out


def embedding_dedup(
    rows: DataFrame, *, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding",
    nearest_pivots: int = NEAREST, block: int = BLOCK, size: int = LIST, most_pivots: int = MOST_PIVOTS,
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept."""
    base = rows.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    table = materialise(base.mapInArrow(_normal, "key long, id long, q binary, dim int"))
    found = links_and_components(table.where("q is not null"), least=least, nearest_pivots=nearest_pivots, block=block, size=size, most_pivots=most_pivots)
    lone = F.col("links").isNull()
    return table.select("key", "id").join(found, "key", "left").select(
        F.col("id").alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(lone, F.col("id")).otherwise(F.col("lowest")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

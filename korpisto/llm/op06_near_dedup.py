"""Operator 6: near-duplicate classes by SetSketch registers.

A text's set is its distinct shingles of ``size`` words; a text of fewer words
is one shingle, and a text without words has an empty set and links with
nothing. One pass gives each set its size, a 128-bit hash and ``BANDS * ROWS``
SetSketch registers: minima of exponential variates on a scale of powers of
``BASE``, truncated to whole exponents. Registers merge by maximum and agree for
two sets about as often as the sets' likeness.

1. Equal sets collapse to one representative each: first within a block of rows, then
   the blocks' representatives, so a set that a third of all rows holds is a row a
   block to any one task. Empty sets take no part.
2. Bands of registers are keys. Of each bucket only pairs with its lowest member
   are made first, within a batch and then between the batches' lowest ones, so a
   group of copies costs a pair a member and sends a row a batch. Of each bucket
   that then still holds several components, the member whose shingles are the
   most common ones is compared with the rest. For what is left open an exact
   join follows: two sets as alike as the threshold share one of their rarest
   shingles, the first ``n - overlap + 1`` by frequency, where the overlap follows from both
   sizes, so only members of different components that share one are paired.
3. The joint likelihood of two sketches, given the exact sizes, estimates the
   likeness; pairs far below the threshold end there.
4. The rest is verified on the full sets of both texts.
5. Components of the verified links come from minimum labels and pointer jumps. A label
   that very many rows ask for, of a hub, a component or a set of equal texts, is first
   told to their distinct pairs with a share, so that no task gets all of them.

Pairs at the threshold itself are missed by all bands with a chance below one
in a million; likelier pairs far more rarely. Rows that share an id are rows of
their own with one component each by their text. Null texts are empty, very long ones
are read whole; an empty table gives no rows. Further columns are not read;
``one_of_each`` returns them unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korpisto.llm.common import BYTE_CODE, U64, drop, keyed, materialise, mix, prefix, shuffle_partitions, spans, text_chunks, told, words_of

BANDS, ROWS = 52, 5
REGISTERS = BANDS * ROWS
LEADS = 2  # pairs of a member that are verified first
BASE, RATE, TOP = 1.001, 20.0, 65534
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FACTORS = (np.random.default_rng(11).integers(0, 1 << 31, REGISTERS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_BAND_MULT = np.random.default_rng(13).integers(0, 1 << 62, (BANDS, ROWS), dtype=np.uint64) << U64(1) | U64(1)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles, sorted by text."""
    data = _LOWER[data]
    starts, ends, text = words_of(data, offsets)
    q = prefix(spans(prefix(BYTE_CODE[data]), starts, ends))
    at = np.arange(max(0, len(starts) - size + 1))
    at = at[text[at] == text[at + size - 1]] if len(at) else at
    count = np.bincount(text, minlength=len(offsets) - 1)
    begin = np.cumsum(count) - count
    short = np.flatnonzero((count > 0) & (count < size))
    h = np.concatenate([spans(q, at, at + size), spans(q, begin[short], begin[short] + count[short])])
    owner = np.concatenate([text[at] if len(at) else at, short])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], h[new]


def registers(h: np.ndarray) -> np.ndarray:
    """SetSketch registers of one set, by its 64-bit hashes."""
    x = (h >> U64(32)).astype(np.uint32)
    high = np.zeros(REGISTERS, np.uint32)
    for k in range(0, len(x), 2048):
        np.maximum(high, (x[k : k + 2048, None] * _FACTORS).max(0), out=high)
    low = -np.log((high.astype(np.float64) + 0.5) / 4294967296.0)  # the least of len(h) exponentials
    return np.clip(np.floor(1 - np.log(low / RATE) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """n x BANDS keys from n x REGISTERS registers."""
    parts = (regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64) + U64(1)) * _BAND_MULT
    return mix(parts.sum(2, dtype=np.uint64) ^ mix(np.arange(1, BANDS + 1, dtype=np.uint64)))


def likeness(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard likeness of each row of two sketch matrices by maximum likelihood, sizes given."""
    up, down = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - up - down
    u = (na / (na + nb))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 129)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
    p1, p2 = p(u - v * grid), p(v - u * grid)
    value = up * np.log(p1) + down * np.log(p2) + same * np.log(np.maximum(1 - p1 - p2, 1e-12))
    return np.take_along_axis(grid, value.argmax(1)[:, None], 1)[:, 0]


def _sketch(size: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId()
        for b in batches:
            key = b.column(0).to_numpy(zero_copy_only=False)
            for first, last, data, offsets in text_chunks(b.column(1)):
                owner, h = shingles(data, offsets, size)
                n = np.bincount(owner, minlength=last - first)
                at = np.concatenate([[0], np.cumsum(n)])
                low, high = (np.concatenate([np.zeros(1, U64), np.cumsum(mix(h ^ U64(salt)), dtype=np.uint64)]) for salt in (1, 2))
                regs = [registers(h[at[i] : at[i + 1]]).tobytes() if n[i] else None for i in range(last - first)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[first:last]), pa.array(n), *(pa.array((c[at[1:]] - c[at[:-1]]).view(np.int64)) for c in (low, high)), pa.array(np.full(last - first, block, np.int64)), pa.array(regs, pa.binary())],
                    names=["key", "n", "low", "high", "block", "regs"],
                )

    return scan


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if len(b):
            keys = band_keys(_matrix(b.column("regs")))
            rest = [pa.array(np.repeat(b.column(c).to_numpy(zero_copy_only=False), BANDS)) for c in ("key", "n", "label")]
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), *rest], names=["band", "key", "n", "label"])


def _own_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each member of a bucket with the batch's lowest one, which stands for itself."""
    for b in batches:
        if len(b):
            key, n = (np.repeat(b.column(c).to_numpy(zero_copy_only=False), BANDS) for c in ("key", "n"))
            band = band_keys(_matrix(b.column("regs"))).reshape(-1).view(np.int64)
            order = np.lexsort((key, band))
            band, key, n = band[order], key[order], n[order]
            new = np.ones(len(band), bool)
            new[1:] = band[1:] != band[:-1]
            lead = np.maximum.accumulate(np.where(new, np.arange(len(band)), 0))
            # a member that is not the lowest needs no bucket: its pair is made
            spread = np.where(new, band, mix(key.astype(U64) ^ band.view(U64)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (spread, key, n, key[lead], n[lead])], names=["band", "key", "n", "a", "na"])


def _stars(percent: int):
    """Sorted by (band, key): each batch's lowest member with the lowest of its bucket, and the pairs made before; whether sizes allow a link."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            band, key, n, own, n_own = (b.column(c).to_numpy(zero_copy_only=False) for c in ("band", "key", "n", "a", "na"))
            if not len(band):
                continue
            made = own != key
            fits = 100 * np.minimum(n, n_own) >= percent * np.maximum(n, n_own)
            yield pa.RecordBatch.from_arrays([pa.array(own[made]), pa.array(key[made]), pa.array(fits[made])], names=["a", "b", "fits"])
            band, key, n = band[~made], key[~made], n[~made]
            if not len(band):
                continue
            new = np.ones(len(band), bool)
            new[1:] = band[1:] != band[:-1]
            new[0] = held is None or held[0] != band[0]
            lead = np.maximum.accumulate(np.where(new, np.arange(len(band)), -1))
            a = np.where(lead >= 0, key[np.maximum(lead, 0)], held[1] if held else 0)
            na = np.where(lead >= 0, n[np.maximum(lead, 0)], held[2] if held else 0)
            held = (band[-1], a[-1], na[-1])
            fits = 100 * np.minimum(n, na) >= percent * np.maximum(n, na)
            yield pa.RecordBatch.from_arrays([pa.array(a[~new]), pa.array(key[~new]), pa.array(fits[~new])], names=["a", "b", "fits"])

    return scan


def _likeliest(pairs: DataFrame) -> DataFrame:
    """The distinct pairs, with the place of each among its member's: those whose sizes allow a link and that share the most buckets come first."""
    counted = pairs.groupBy("a", "b", "fits").agg(F.count("*").alias("shared"))
    nth = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("fits"), F.desc("shared"), "a"))  # two pairs a band at most
    return counted.select("a", "b", "fits", nth.alias("nth"))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs that no links join yet."""
    known = told(pairs.select("a", "b"), labels.select(F.col("key").alias("a"), F.col("label").alias("la")), "a", "b", "left")
    known = known.join(labels.select(F.col("key").alias("b"), F.col("label").alias("lb")).hint("merge"), "b", "left")
    return known.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def _shingle_rows(size: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(0).to_numpy(zero_copy_only=False)
            for first, _, data, offsets in text_chunks(b.column(1)):
                owner, h = shingles(data, offsets, size)
                yield pa.RecordBatch.from_arrays([pa.array(key[first + owner]), pa.array(h.view(np.int64))], names=["key", "h"])

    return scan


def _estimate(least: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            na, nb = (b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("na", "nb"))
            got = [likeness(_matrix(b.column("ra").slice(k, 2048)), _matrix(b.column("rb").slice(k, 2048)), na[k : k + 2048], nb[k : k + 2048]) for k in range(0, len(b), 2048)]
            ok = pa.array(np.concatenate(got) >= least)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], names=["a", "b"])

    return scan


def _verify(size: int, percent: int):
    def one(text: str) -> np.ndarray:
        data = np.frombuffer((text or "").encode(), np.uint8)
        return shingles(data, np.array([0, len(data)]), size)[1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None
        for b in batches:
            ok = []
            for a, ta, tb in zip(*(b.column(c).to_pylist() for c in ("a", "ta", "tb"))):
                if a != last:
                    last, known = a, one(ta)
                other = one(tb)
                common = len(np.intersect1d(known, other, assume_unique=True))
                ok.append(100 * common >= percent * (len(known) + len(other) - common))
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(mask), b.column("b").filter(mask)], names=["a", "b"])

    return scan


def components(links: DataFrame) -> DataFrame:
    """(key, label): the lowest key that each linked key reaches. ``links`` has a and b."""
    both = materialise(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("key"), F.least("a", "m").alias("label")))
    while True:
        near = told(both, labels.withColumnRenamed("key", "b"), "b", "a").groupBy("a").agg(F.min("label").alias("m")).withColumnRenamed("a", "key")
        lower = labels.join(near, "key").select("key", "label", F.least("label", "m").alias("next"))
        jump = labels.select(F.col("key").alias("next"), F.col("label").alias("beyond"))
        moved = materialise(told(lower, jump, "next", "key").select("key", "label", F.least("next", "beyond").alias("next")))
        changed = moved.where("next < label").limit(1).count()
        drop(labels)
        labels = materialise(moved.select("key", F.col("next").alias("label")))
        drop(moved)
        if not changed:
            drop(both)
            return labels


def _several(rows: DataFrame) -> DataFrame:
    """The rows of buckets with more than one label, with the bucket's members and least size."""
    kinds = rows.groupBy("band").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.count("*").alias("members"), F.min("n").alias("least")).where("l0 < l1")
    return rows.join(kinds.select("band", "members", "least"), "band")


def _across(rows: DataFrame, heads: DataFrame, on: str, percent: int, once: bool = False) -> DataFrame:
    """Pairs of different labels with one value of ``on`` whose sizes allow a link.

    ``once``: both sides are the same rows, of shingles at a ``place`` in their
    set's order; the first shingle that a pair shares has places low enough for
    the overlap that its sizes ask for.
    """
    heads = heads.select(on, F.col("key").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"), *([F.col("place").alias("pa")] if once else []))
    fits = (F.col("label") != F.col("la")) & (100 * F.least("n", "na") >= percent * F.greatest("n", "na"))
    if once:
        common = F.ceil(percent * (F.col("n") + F.col("na")) / (100 + percent))  # the least overlap of such a pair
        fits &= (F.col("a") < F.col("key")) & (F.col("place") <= F.col("n") - common + 1) & (F.col("pa") <= F.col("na") - common + 1)
    return rows.join(heads, on).where(fits).select(F.least("a", "key").alias("a"), F.greatest("a", "key").alias("b"))


def classes(base: DataFrame, *, size: int = 5, percent: int = 75) -> DataFrame:
    """(key, n, component): set size and the lowest key reachable, for ``base`` with unique key, and text."""
    parts = shuffle_partitions(base.sparkSession)
    sketches = materialise(base.select("key", "text").mapInArrow(_sketch(size), "key long, n long, low long, high long, block long, regs binary"))
    filled = sketches.where("n > 0")
    by_block = filled.groupBy("low", "high", "block").agg(F.min("key").alias("first"))
    whole = by_block.groupBy("low", "high").agg(F.min("first").alias("rep"))
    by_rep = by_block.join(whole.hint("merge"), ["low", "high"]).select("low", "high", "block", "rep")
    equal = filled.select("key", "n", "low", "high", "block").join(by_rep.hint("merge"), ["low", "high", "block"]).select("key", "n", "rep")
    members = materialise(equal.unionByName(sketches.where("n = 0").select("key", "n", F.col("key").alias("rep"))))
    chosen = members.where("n > 0 and key = rep").select("key")
    reps = materialise(filled.select("key", "n", "regs").join(chosen.hint("merge"), "key", "left_semi"))
    drop(sketches)

    # Pairs with the lowest member of each bucket, and the texts of all who share one.
    band_type = "band long, key long, n long, label long"
    rows = reps.select("key", "n", "regs").mapInArrow(_own_stars, "band long, key long, n long, a long, na long")
    made = rows.repartition(parts, "band").sortWithinPartitions("band", "key").mapInArrow(_stars(percent), "a long, b long, fits boolean")
    stars = materialise(_likeliest(made))
    sharing = stars.select(F.col("a").alias("key")).union(stars.select("b")).distinct()
    texts = materialise(base.select("key", "text").join(sharing.hint("merge"), "key", "left_semi"))  # keys grow with the corpus
    least = percent / 100 - 6 * (percent / 100 * (1 - percent / 100) / REGISTERS) ** 0.5

    def verified(pairs: DataFrame) -> DataFrame:
        side = reps.select("key", "n", "regs")
        first = side.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
        second = side.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
        likely = pairs.distinct().hint("merge").join(first, "a").hint("merge").join(second, "b").select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_estimate(least), "a long, b long")
        with_b = likely.hint("merge").join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b")
        with_both = with_b.hint("merge").join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")
        return materialise(with_both.mapInArrow(_verify(size, percent), "a long, b long"))

    found = [verified(stars.where(F.col("fits") & (F.col("nth") <= LEADS)).select("a", "b"))]
    labels = components(found[0])

    # The most usual member of each open bucket, then all pairs that share a rare shingle.
    def opened() -> DataFrame:
        known = reps.join(labels, "key", "left").select("key", "n", "regs", F.coalesce("label", "key").alias("label"))
        return materialise(_several(known.mapInArrow(_bands, band_type)).select("band", "key", "n", "label"))

    open_ = opened()
    owners = texts.join(open_.select("key").distinct(), "key", "left_semi").mapInArrow(_shingle_rows(size), "key long, h long")
    held = owners.groupBy("h").agg(F.count("*").alias("held"))
    shared = owners.join(held, "h").select("key", "h", "held")
    place = F.row_number().over(Window.partitionBy("key").orderBy("held", "h"))
    total = F.sum(F.log2("held")).over(Window.partitionBy("key"))
    size_of = F.count("*").over(Window.partitionBy("key"))
    ranked = shared.select("key", "h", place.alias("place"), size_of.alias("n"), total.alias("usual"))
    rare = materialise(ranked.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).withColumn("usual", F.col("usual") / F.col("n")))
    usual = rare.where("place = 1").select("key", "usual")
    best = open_.join(usual, "key").groupBy("band").agg(F.max_by("key", F.struct("usual", -F.col("key"))).alias("key"))
    across = _across(open_, open_.join(best, ["band", "key"], "left_semi"), "band", percent)
    found.append(verified(across.union(_apart(stars.where(F.col("fits") & (F.col("nth") > LEADS)), labels))))
    drop(stars)
    drop(labels)
    labels = components(reduce(DataFrame.union, found))
    drop(open_)
    open_ = opened()
    left = open_.select("key", "label").distinct()
    posts = rare.select("h", "key", "n", "place").join(left, "key")
    several = posts.groupBy("h").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 < l1").select("h")
    posts = posts.join(several, "h", "left_semi")
    pairs = _across(posts, posts, "h", percent, once=True)
    found.append(verified(pairs))
    drop(labels)
    labels = components(reduce(DataFrame.union, found))
    for table in (open_, rare, texts, reps, *found):
        drop(table)
    return told(members, labels.withColumnRenamed("key", "rep"), "rep", "key", "left").select("key", "n", F.coalesce("label", "rep").alias("component"))


def near_dedup(docs: DataFrame, *, size: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    base, table = keyed(docs, id_col, text_col)
    found = classes(base, size=size, percent=percent)
    if table is None:
        rows = found.select(F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    else:
        ids = found.join(base.select("key", "id"), "key")
        lowest = ids.groupBy("component").agg(F.min("id").alias("component_id"))
        rows = told(ids, lowest, "component", "key").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, *, size: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input without all but the row of lowest id of each component; null ids come last."""
    packed = docs.select(F.col(id_col), F.col(text_col), F.struct(*docs.columns).alias("rest"))
    base, table = keyed(packed, id_col, text_col, "rest")
    found = classes(base, size=size, percent=percent)
    if table is None:  # the key is the id
        first = found.where("key = component").select("key")
    else:
        ids = found.join(base.select("key", F.coalesce("id", F.lit((1 << 63) - 1)).alias("id")), "key")
        first = ids.groupBy("component").agg(F.min(F.struct("id", "key")).alias("first")).select("first.key")
    return base.join(first, "key", "left_semi").select("rest.*")

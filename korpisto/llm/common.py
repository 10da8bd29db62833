"""Pieces that the training-data operators share.

Every operator reads only its identifier and text columns, so further columns
of the input, whatever their names, can't clash with the columns it returns.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from korpisto.session import ship, shuffle_partitions

__all__ = [
    "documents", "labels", "table", "materialise", "drop", "shuffle_partitions", "ship",
    "text_chunks", "prefix", "spans", "told", "mix", "words_of", "keyed", "WHITE", "doc_ids",
]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --------------------------------------------------------------- written tables
def _shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="korpisto-checkpoint")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        folder = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_written: dict[int, tuple] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage in a way that survives lost executors. The table goes
    with ``drop`` or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/korpisto-{uuid.uuid4().hex}"
    kept = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # what this write shuffled is read by no later step
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if kept is None else spark.conf.set(_CLEANUP, kept)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.deleteOnExit(jvm_path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[id(out)] = (fs, jvm_path)
    return out


def drop(df: DataFrame) -> None:
    """Delete a table of ``materialise`` that no later step reads."""
    if id(df) not in _written:
        return
    fs, path = _written.pop(id(df))
    fs.delete(path, True)
    free_shuffles(df.sparkSession)


def free_shuffles(spark: SparkSession) -> None:
    """Have the files of shuffles that no later step reads removed."""
    gc.collect()
    spark._jvm.System.gc()


def keyed(docs: DataFrame, id_col: str, text_col: str, *carry: str) -> tuple[DataFrame, DataFrame | None]:
    """(key, id, text, carried columns) with a key that is unique even where ids repeat or are null.

    Where ids are unique, the key is the id. Otherwise the rows are written once
    and numbered by their place in the written table, which does not change
    between reads. The second value is that table, if any.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *carry)
    odd = base.groupBy("id").count().where("count > 1 or id is null").limit(1).count()
    if not odd:
        return base.select(F.col("id").alias("key"), "id", "text", *carry), None
    table = materialise(base)
    return table.select(F.monotonically_increasing_id().alias("key"), "id", "text", *carry), table


def told(rows: DataFrame, answers: DataFrame, on: str, spread: str, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``answers``, which has each value of ``on`` once at most.

    A value that very many rows hold is dealt by ``spread`` to as many tasks as a
    shuffle has: the answer first goes to the distinct pairs of value and share.
    """
    share = F.pmod(F.xxhash64(spread), F.lit(shuffle_partitions(rows.sparkSession))).cast("int")
    dealt = rows.withColumn("share", share)
    known = dealt.select(on, "share").distinct().join(answers.hint("merge"), on)
    return dealt.join(known.hint("merge"), [on, "share"], how).drop("share")


def chunked(df: DataFrame, text: str, size: int) -> DataFrame:
    """The input with the number of each row's chunk, of about ``size`` bytes of text in a row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            ends = done + np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
            yield b.append_column("chunk", pa.array(task + np.concatenate([[done], ends[:-1]]).astype(np.int64)[: len(b)] // size))
            done = int(ends[-1]) if len(ends) else done

    return df.mapInArrow(scan, T.StructType([*df.schema.fields, T.StructField("chunk", T.LongType())]))


# ------------------------------------------------------------- arrays over text
U64 = np.uint64
#: Hashes are polynomials modulo this prime, so no pair of texts collides whatever the base.
PRIME = (1 << 61) - 1
_P, _LOW31, _LOW30 = U64(PRIME), U64((1 << 31) - 1), U64((1 << 30) - 1)
_MULT = 0x15D1A3C94F2E7B6B


def _splitmix(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) + U64(seed)
        z = (z ^ (z >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> U64(27))) * U64(0x94D049BB133111EB)
    return z ^ (z >> U64(31))


def reduced(x: np.ndarray) -> np.ndarray:
    """Numbers modulo PRIME."""
    x = (x & _P) + (x >> U64(61))
    return x - _P * (x >= _P)


def product(a: np.ndarray, b: np.ndarray, block: int = 1 << 14) -> np.ndarray:
    """Products modulo PRIME, of numbers below it, in blocks that stay in a core's cache."""
    if len(a) > block and b.ndim:
        out = np.empty(len(a), U64)
        for k in range(0, len(a), block):
            out[k : k + block] = product(a[k : k + block], b[k : k + block])
        return out
    ah, al, bh, bl = a >> U64(31), a & _LOW31, b >> U64(31), b & _LOW31
    mid = ah * bl + al * bh
    return reduced(U64(2) * (ah * bh) + (mid >> U64(30)) + ((mid & _LOW30) << U64(31)) + al * bl)


BYTE_CODE = reduced(_splitmix(256, 0x5DEECE66D))
WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, modulo PRIME."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_MULT, pow(_MULT, -1, PRIME))):
            table = _powers[k]
            while len(table) < n:
                table = np.concatenate([table, product(table, U64(pow(base, len(table), PRIME)))])
            _powers[k] = table
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(29))) * U64(0x9FB21C651E98DF25)
    return x ^ (x >> U64(32))


def prefix(codes: np.ndarray, block: int = 1 << 14) -> np.ndarray:
    """Prefix sums of a Rabin-Karp polynomial over symbol codes, modulo PRIME."""
    powers, out = _power_tables(len(codes) + 1)[0], np.zeros(len(codes) + 1, U64)
    before = U64(0)
    for k in range(0, len(codes), block):
        terms = product(reduced(codes[k : k + block]), powers[k : k + len(codes[k : k + block])])
        high, low = np.cumsum(terms >> U64(31)), np.cumsum(terms & _LOW31)  # exact: two halves of 31 bits
        part = out[k + 1 : k + 1 + block]
        part[:] = reduced(before + reduced((high >> U64(30)) + ((high & _LOW30) << U64(31)) + reduced(low)))
        before = part[-1]
    return out


def spans(p: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = 1 << 14) -> np.ndarray:
    """Hashes of the symbols in [start, end), from ``prefix``."""
    inverse, out = _power_tables(len(p))[1], np.empty(len(start), U64)
    for k in range(0, len(start), block):
        a, b = start[k : k + block], end[k : k + block]
        out[k : k + block] = mix(product(reduced(p[b] + (_P - p[a])), inverse[a]) + (b - a).astype(U64))
    return out


def coded(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as the first one and the differences, in as many bytes as the largest takes."""
    if not len(keys):
        return b""
    steps = np.diff(keys)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def decoded(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, U64)
    width = data[0]
    steps = np.zeros(((len(data) - 9) // width, 8), np.uint8)
    steps[:, :width] = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    return np.cumsum(np.concatenate([np.frombuffer(data, "<u8", 1, 1), steps.view("<u8").reshape(-1)]), dtype=U64)


def text_chunks(column: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, UTF-8 bytes, row offsets) of about ``limit`` bytes.

    A longer text is a chunk of its own. Null texts count as empty.
    """
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last
    _give_back()


def _give_back() -> None:
    """Return freed memory to the system: a worker lives on and runs other steps."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own counsel
        pass


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words ``[^\\x20\\x09-\\x0D]+``."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~WHITE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    here = inside[1:-1]
    starts = np.flatnonzero(here & (~inside[:-2] | first[:-1]))
    ends = np.flatnonzero(here & (~inside[2:] | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def doc_ids(column: pa.Array) -> pa.Array:
    return column.cast(pa.int64())

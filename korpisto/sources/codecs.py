"""Binary layouts of frequency lists and tagger models."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ModelError(ValueError):
    pass


def frequency_bytes(words: DataFrame) -> bytes:
    """(word, count) as total, number of entries, then length, word and count of each."""
    rows = words.select("word", "count").orderBy("word").collect()  # a list for one process, by its nature
    out = [struct.pack("<II", sum(r[1] for r in rows), len(rows))]
    for r in rows:
        raw = r[0].encode()
        out.append(struct.pack("<H", len(raw)) + raw + struct.pack("<I", r[1]))
    return b"".join(out)


def read_frequency(spark: SparkSession, data: bytes) -> DataFrame | None:
    """(word, count), or None for malformed bytes."""
    try:
        _, n = struct.unpack_from("<II", data)
        at, rows = 8, []
        for _ in range(n):
            (size,) = struct.unpack_from("<H", data, at)
            raw = data[at + 2 : at + 2 + size]
            if len(raw) != size:
                return None
            (count,) = struct.unpack_from("<I", data, at + 2 + size)
            rows.append((raw.decode(), count))
            at += 6 + size
    except (struct.error, UnicodeDecodeError):
        return None
    return spark.createDataFrame(rows, "word string, count long")


@dataclass
class TaggerModel:
    classes: list[str]
    features: dict[str, int]
    intercepts: np.ndarray  # float32, by class
    scale: float
    weights: np.ndarray  # int8, class x feature

    MAGIC = b"MCET"
    VERSION = 1

    def to_bytes(self) -> bytes:
        text = lambda s: struct.pack("<H", len(s.encode())) + s.encode()
        head = self.MAGIC + struct.pack("<III", self.VERSION, len(self.features), len(self.classes))
        names = b"".join(map(text, self.classes)) + b"".join(text(f) + struct.pack("<I", i) for f, i in self.features.items())
        return head + names + self.intercepts.astype("<f4").tobytes() + struct.pack("<f", self.scale) + self.weights.astype(np.int8).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> TaggerModel:
        at = 0

        def take(n: int) -> bytes:
            nonlocal at
            if at + n > len(data):
                raise ModelError(f"truncated model: {at + n} bytes expected, {len(data)} there")
            at += n
            return data[at - n : at]

        def number() -> int:
            return struct.unpack("<I", take(4))[0]

        def text() -> str:
            raw = take(struct.unpack("<H", take(2))[0])
            try:
                return raw.decode()
            except UnicodeDecodeError as e:
                raise ModelError("a name is no UTF-8") from e

        if take(4) != cls.MAGIC:
            raise ModelError("no tagger model")
        if (version := number()) != cls.VERSION:
            raise ModelError(f"version {version} is unknown")
        n_features, n_classes = number(), number()
        classes = [text() for _ in range(n_classes)]
        features = {}
        for _ in range(n_features):
            name = text()
            features[name] = number()
        intercepts = np.frombuffer(take(4 * n_classes), "<f4")
        scale = struct.unpack("<f", take(4))[0]
        weights = np.frombuffer(take(n_features * n_classes), np.int8).reshape(n_classes, n_features)
        return cls(classes, features, intercepts, scale, weights)

    def table(self, spark: SparkSession) -> DataFrame:
        """(feature, class, weight) of non-zero weights."""
        rows = [(f, c, float(self.weights[k, i]) * self.scale) for f, i in self.features.items() for k, c in enumerate(self.classes) if self.weights[k, i]]
        return spark.createDataFrame(rows, "feature string, class string, weight double").where(F.col("weight") != 0)


# ---------------------------------------------------------------- succinct tries
TRIE_MAGIC = b"MCT1"


def _bits(flags: list[bool]) -> bytes:
    """Length, words of 64 bits from the lowest, and the ones before each word."""
    packed = np.packbits(np.array(flags, np.uint8), bitorder="little") if flags else np.zeros(0, np.uint8)
    words = np.frombuffer(packed.tobytes() + b"\0" * (-len(packed) % 8), "<u8")
    ones = [bin(int(w)).count("1") for w in words]
    ranks = np.concatenate([[0], np.cumsum(ones)]).astype("<u4")
    return struct.pack("<QQ", len(flags), len(words)) + words.tobytes() + ranks.tobytes()


def _read_bits(data: bytes, at: int) -> tuple[list[bool], int]:
    n, words = struct.unpack_from("<QQ", data, at)
    end = at + 16 + 8 * words
    if end + 4 * (words + 1) > len(data) or n > 64 * words:
        raise ModelError("truncated trie")
    flags = np.unpackbits(np.frombuffer(data[at + 16 : end], np.uint8), bitorder="little")[:n]
    return flags.astype(bool).tolist(), end + 4 * (words + 1)


def trie_bytes(words: list[str]) -> bytes:
    """A word list as a trie over bytes, level by level: a one for each child, a zero at a node's end."""
    keys = sorted({w.encode() for w in words})
    tree, labels, terminal = ([True, False], bytearray(), []) if keys else ([], bytearray(), [])
    level = [keys] if keys else []
    depth = 0
    while level:
        below = []
        for group in level:
            terminal.append(len(group[0]) == depth)
            rest = [k for k in group if len(k) > depth]
            for byte in dict.fromkeys(k[depth] for k in rest):
                tree.append(True)
                labels.append(byte)
                below.append([k for k in rest if k[depth] == byte])
            tree.append(False)
        level, depth = below, depth + 1
    return TRIE_MAGIC + struct.pack("<Q", len(labels)) + bytes(labels) + _bits(tree) + _bits(terminal)


def read_trie(spark: SparkSession, data: bytes) -> DataFrame | None:
    """(word), or None for malformed bytes."""
    if data[:4] != TRIE_MAGIC or len(data) < 12:
        return None
    try:
        (n,) = struct.unpack_from("<Q", data, 4)
        labels = data[12 : 12 + n]
        tree, at = _read_bits(data, 12 + n)
        terminal, _ = _read_bits(data, at)
    except (ModelError, struct.error):
        return None
    names, place, out = [b""], 0, []
    for node, flag in enumerate(terminal):  # nodes come in the order in which their labels were read
        if flag:
            out.append((names[node].decode(errors="replace"),))
        place = place + 2 if node == 0 else place
        while tree[place]:
            names.append(names[node] + labels[len(names) - 1 : len(names)])
            place += 1
        place += 1
    return spark.createDataFrame(out, "word string")

"""Operator 2: SentencePiece encoding and decoding as a weighted transducer.

``Transducer.load`` compiles a model file into three machines: the normaliser
(character map, dummy prefix, escaped spaces), the lexicon of pieces, and byte
fallback for characters without a piece. Composing them with a text gives a
lattice whose arcs carry tropical weights; the ids are its shortest path.

- Unigram models: an arc weighs minus its piece's score, an unknown character
  ten more than the worst piece.
- BPE models: an arc weighs 0 where the piece may follow the one before it and
  infinity otherwise: two pieces may be neighbours exactly if merging their
  joined text by rank gives these two pieces again. A sequence of pieces is the
  merge result exactly if all its neighbours are allowed, so one path is finite.

No piece continues over a space, so the path of a text is the paths of its
space-led segments in a row; each worker remembers those of up to ``keep``
recent segments and as many older ones.

Null and empty texts have no ids; very long texts are read whole. Ids may be null or
repeat: rows are encoded each on its own. An empty table gives no rows. Further
columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_loaded: dict[str, Transducer] = {}
_MARKED = re.compile(r"(.*\w)([^\w\s]+)", re.DOTALL)


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: object = varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            value = data[at : at + size]
            at += size
        yield tag >> 3, value


class CharacterMap:
    """The compiled character map of a model: longest match in a double array."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.strings = blob[4 + size :]

    def __call__(self, text: str) -> str:
        if not self.units:
            return text
        data, out, at = text.encode(), bytearray(), 0
        while at < len(data):
            length, value = self._longest(data, at)
            if length:
                out += self.strings[value : self.strings.index(b"\0", value)]
                at += length
            else:
                step = 1
                while at + step < len(data) and data[at + step] & 0xC0 == 0x80:
                    step += 1
                out += data[at : at + step]
                at += step
        return out.decode()

    def _longest(self, data: bytes, at: int) -> tuple[int, int]:
        units, found = self.units, (0, 0)

        def offset(unit: int) -> int:
            return (unit >> 10) << ((unit & 512) >> 6)

        node = offset(units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            unit = units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= offset(unit)
            if (unit >> 8) & 1:
                found = (k + 1 - at, units[node] & 0x7FFFFFFF)
        return found


class Transducer:
    def __init__(self, model: bytes, keep: int = 400_000):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        self.bpe, self.byte_fallback, self.unknown = False, False, 0
        blob, self.dummy, self.squeeze, self.escape = b"", True, True, True
        for number, value in _fields(model):
            if number == 1:
                got = dict(_fields(value))
                self.pieces.append(got.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", got[2])[0] if 2 in got else 0.0)
                self.types.append(got.get(3, NORMAL))
            elif number == 2:
                got = dict(_fields(value))
                self.bpe = got.get(3, 1) == 2
                self.byte_fallback = bool(got.get(35, 0))
                self.suffix = bool(got.get(24, 0))
            elif number == 3:
                got = dict(_fields(value))
                blob = got.get(2, b"")
                self.dummy, self.squeeze, self.escape = (bool(got.get(k, 1)) for k in (3, 4, 5))
        self.map = CharacterMap(blob)
        plain = [i for i, t in enumerate(self.types) if t in (NORMAL, USER)]
        self.lexicon = {self.pieces[i]: i for i in plain}
        self.user = sorted((self.pieces[i] for i in plain if self.types[i] == USER), key=len, reverse=True)
        self.user_pattern = re.compile("|".join(map(re.escape, self.user))) if self.user else None
        self.longest = max(map(len, self.lexicon), default=1)
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = self.types.index(UNKNOWN) if UNKNOWN in self.types else 0
        self.worst = min((self.scores[i] for i in plain if self.types[i] == NORMAL), default=0.0) - 10
        inner = set().union(*(set(p) for p in self.lexicon if len(p) > 1)) if self.lexicon else set()
        self.apart = "\n" not in inner  # a line feed is then a segment of its own
        self.by_space = self.escape and not any(SPACE in p.lstrip(SPACE) for p in self.lexicon)
        self.allowed: dict[tuple[str, str], bool] = {}
        self.arcs, self.final = self._compiled()
        self.joined = {p[k : k + 2] for p in self.lexicon for k in range(len(p) - 1)}  # characters that stand together in a piece
        self.keep, self.known, self.older = keep, {}, {}

    @classmethod
    def load(cls, path: str) -> Transducer:
        if path not in _loaded:
            with open(path, "rb") as f:
                _loaded[path] = cls(f.read())
        return _loaded[path]

    # ------------------------------------------------------------ normaliser
    def normalise(self, text: str) -> str:
        text = self.map(text)
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if self.dummy and text:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text

    # --------------------------------------------------------------- lattice
    def _merge(self, text: str) -> list[str]:
        """The pieces of a short text by merging the best-ranked neighbours."""
        parts = list(text)
        while True:
            best = None
            for k in range(len(parts) - 1):
                i = self.lexicon.get(parts[k] + parts[k + 1])
                if i is not None and self.types[i] == NORMAL and (best is None or self.scores[i] > best[0]):
                    best = (self.scores[i], k)
            if best is None:
                return parts
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def follows(self, left: str, right: str) -> bool:
        """Whether the arc of ``right`` after ``left`` has a finite weight."""
        got = self.allowed.get((left, right))
        if got is None:
            got = self._merge(left + right) == ([left, right] if left else [right])
            if len(self.allowed) < 2_000_000:
                self.allowed[left, right] = got
        return got

    def _compiled(self) -> tuple[list[dict[str, int]], list[int]]:
        """The lexicon's machine: the arcs of each state by character, and the piece that ends there or -1. State 0 starts."""
        arcs: list[dict[str, int]] = [{}]
        final = [-1]
        for piece, i in self.lexicon.items():
            state = 0
            for c in piece:
                following = arcs[state].get(c)
                if following is None:
                    following = arcs[state][c] = len(arcs)
                    arcs.append({})
                    final.append(-1)
                state = following
            final[state] = i
        return arcs, final

    def shortest(self, text: str) -> list[str]:
        """The pieces and unknown characters on the shortest path through one stretch.

        The stretch as a chain of characters is composed with the lexicon's machine,
        which begins anew at each place that has a finite cost, and with byte
        fallback's, one arc for a character that is no piece. Arcs leave a place in
        order of length. In a BPE lattice a place has one finite path, so the first
        one found is kept.
        """
        n, arcs, final, scores = len(text), self.arcs, self.final, self.scores
        infinite, bpe, allowed, root = float("inf"), self.bpe, self.allowed, self.arcs[0]
        cost = [0.0] + [infinite] * n
        piece: list[str] = [""] * (n + 1)
        for begin in range(n):
            last, so_far = piece[begin], cost[begin]
            if so_far == infinite:
                continue
            state, end = root.get(text[begin], -1), begin + 1
            fallback = state < 0 or final[state] < 0
            while fallback or state >= 0:
                i = -1 if fallback else final[state]
                if i >= 0 or fallback:
                    arc = text[begin:end]
                    if not bpe:
                        weight = so_far - (self.worst if fallback else scores[i])
                        if weight < cost[end]:
                            cost[end], piece[end] = weight, arc
                    elif cost[end] == infinite:
                        fits = allowed.get((last, arc))
                        if fits is None:
                            fits = self.follows(last, arc)
                        if fits:
                            cost[end], piece[end] = 0.0, arc
                fallback = False
                if state < 0 or end == n:
                    break
                state, end = arcs[state].get(text[end], -1), end + 1
        if cost[n] == infinite:
            raise ValueError("no finite path: the model's pieces can't be reached by merges")
        out, at = [], n
        while at:
            out.append(piece[at])
            at -= len(piece[at])
        return out[::-1]

    def _ids(self, segment: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a segment."""
        ids: list[int] = []
        at = 0
        stretches: list[tuple[str, bool]] = []
        if self.user_pattern:
            for m in self.user_pattern.finditer(segment):
                stretches += [(segment[at : m.start()], False), (m[0], True)]
                at = m.end()
        stretches.append((segment[at:], False))
        for stretch, whole in stretches:
            for piece in [stretch] if whole else self.shortest(stretch):
                i = self.lexicon.get(piece)
                if i is not None:
                    ids.append(i)
                elif self.byte_fallback:
                    ids += [self.bytes[b] for b in piece.encode()]
                else:
                    ids.append(self.unknown)
        return np.array(ids, "<u4").tobytes()

    def segments(self, normal: str) -> list[str]:
        if not self.by_space:
            return [normal]
        if SPACE * 2 in normal or not normal.startswith(SPACE) or normal.endswith(SPACE):
            found = re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", normal)
        else:
            found = [SPACE + w for w in normal[1:].split(SPACE)]
        if not self.apart or "\n" not in normal:
            return found
        return [x for w in found for x in (re.split("(\n)", w) if "\n" in w else (w,)) if x]

    def encode(self, text: str) -> bytes:
        known, out = self.known, []
        for segment in self.segments(self.normalise(text)):
            ids = known.get(segment)
            if ids is None:
                ids = self._recall(segment)
                if len(known) >= self.keep:
                    self.known, self.older = {}, known
                    known = self.known
                known[segment] = ids
            out.append(ids)
        return b"".join(out)

    def _recall(self, segment: str) -> bytes:
        """Ids of a segment that is not among the recent ones.

        Marks behind letters are a stretch of their own where no piece holds both
        characters of the place between them, since no merge crosses it.
        """
        ids = self.older.get(segment)
        if ids is None:
            m = _MARKED.fullmatch(segment)
            if m and self.bpe and m[1][-1] + m[2][0] not in self.joined:
                parts = []
                for part in m.groups():
                    if part not in self.known:
                        got = self.older.get(part)
                        self.known[part] = self._ids(part) if got is None else got
                    parts.append(self.known[part])
                return b"".join(parts)
            ids = self._ids(segment)
        return ids

    # --------------------------------------------------------------- inverse
    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that form no character become U+FFFD."""
        out = bytearray()
        for i in ids.tolist():
            kind = self.types[i]
            if kind == BYTE:
                out.append(self.byte_of[i])
            elif kind in (NORMAL, USER):
                out += self.pieces[i].encode()
            elif kind == UNKNOWN:
                out += " ⁇ ".encode()
        text = out.decode(errors="replace")
        if self.escape:
            text = text.replace(SPACE, " ")
        return text[1:] if self.dummy and text.startswith(" ") else text


def encode_decode(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_crc32, decoded_sha256, round_trip[, ids].

    ``round_trip`` says whether decoding gives the normalised text again, which
    it does for every text without a literal U+2581 where nothing is unknown.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Transducer.load(model)
        for b in batches:
            counts, crcs, digests, same, all_ids = [], [], [], [], []
            for text in pc.fill_null(b.column(1), "").to_pylist():
                data = t.encode(text)
                ids = np.frombuffer(data, "<u4")
                back = t.decode(ids)
                counts.append(len(ids))
                crcs.append(zlib.crc32(data))
                digests.append(hashlib.sha256(back.encode()).hexdigest())
                normal = t.normalise(text)
                same.append(back == (normal[1:] if t.dummy else normal).replace(SPACE, " "))
                all_ids.append(ids.astype(np.int32) if with_ids else None)
            columns = [b.column(0), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64()), pa.array(digests, pa.string()), pa.array(same, pa.bool_())]
            names = ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"]
            if with_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    source = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return source.mapInArrow(scan, "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids)

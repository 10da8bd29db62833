"""Finite-state dictionaries in the VFST binary layout: reader and traversal.

A file has a 16-byte header, a symbol table and fixed-size transitions. States
are read into lists of arcs when first visited; a depth-first walk with an undo
list for flags yields outputs in the order of the file's arcs.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

# The layout.
MAGIC = (0x00013A6E, 0x000351FA)
HEADER = 16
FINAL, WEIGHTED_FINAL = 0xFFFF, 0xFFFFFFFF
STEP_LIMIT, BUFFER = 100_000, 2000
NEUTRAL, ANY = 0, 1
# End of fixed values.


class VfstError(ValueError):
    pass


@dataclass
class Flag:
    op: str
    feature: int
    value: int

    def apply(self, current: int) -> int | None:
        """The feature's next value, or None where the flag forbids the arc."""
        if self.op == "P":
            return self.value
        if self.op == "C":
            return NEUTRAL
        if self.op == "U":
            return self.value if current in (NEUTRAL, self.value) else None
        if self.op == "R":
            ok = current != NEUTRAL if self.value == ANY else current == self.value
        else:
            ok = current != self.value and not (self.value == ANY and current != NEUTRAL)
        return current if ok else None


@dataclass
class Symbols:
    strings: list[str] = field(default_factory=lambda: [""])
    flags: list[Flag | None] = field(default_factory=lambda: [None])
    by_char: dict[str, int] = field(default_factory=dict)
    first_normal: int = 0
    first_multi: int = 0
    features: dict[str, int] = field(default_factory=dict)


def header(data: bytes) -> bool:
    """Whether the dictionary is weighted."""
    if len(data) < HEADER:
        raise VfstError(f"{HEADER} bytes of header expected, {len(data)} there")
    if struct.unpack_from("<II", data) != MAGIC:
        raise VfstError("no VFST file")
    return data[8] == 1


def symbol_table(data: bytes, at: int = HEADER) -> tuple[Symbols, int]:
    """The table and where it ends. Flags come first, then characters, then ``[`` symbols."""
    if len(data) < at + 2:
        raise VfstError("no symbol count")
    (count,), at = struct.unpack_from("<H", data, at), at + 2
    out, values = Symbols(), {"": NEUTRAL, "@": ANY}
    for i in range(count):
        end = data.find(b"\0", at)
        if end < 0:
            raise VfstError("a symbol without an end")
        raw, at = data[at:end], end + 1
        if i == 0:
            continue
        try:
            text = raw.decode()
        except UnicodeDecodeError as e:
            raise VfstError(f"symbol {i} is no UTF-8") from e
        out.strings.append(text)
        if not out.first_normal and text.startswith("@"):
            if len(raw) <= 4 or text[1] not in "PCURD":
                raise VfstError(f"bad flag {text!r}")
            name, dot, value = text[3:-1].partition(".")
            feature = out.features.setdefault(name, len(out.features))
            out.flags.append(Flag(text[1], feature, values.setdefault(value if dot else "@", len(values))))
            continue
        if not out.first_normal:
            out.first_normal = i
        elif not out.first_multi and text.startswith("["):
            out.first_multi = i
        if not out.first_multi and text:
            out.by_char[text[0]] = i
    if out.first_normal and not out.first_multi:
        out.first_multi = count
    return out, at


class Dictionary:
    """A transducer over characters. ``outputs(word)`` yields (text, weight)."""

    def __init__(self, data: bytes, weighted: bool | None = None):
        kind = header(data)
        if weighted is not None and weighted != kind:
            raise VfstError(f"a {'weighted' if weighted else 'plain'} dictionary was expected")
        self.weighted = kind
        self.size = 16 if kind else 8
        self.symbols, end = symbol_table(data)
        start = -(-end // self.size) * self.size
        self.count = (len(data) - start) // self.size
        if self.count <= 0:
            raise VfstError("no transitions")
        self.data = memoryview(data)[start : start + self.count * self.size]
        self.final = WEIGHTED_FINAL if kind else FINAL
        self.states: dict[int, list[tuple[int, int, int, int]]] = {}
        if not kind:
            for k in range(self.count):
                sym, _, info = struct.unpack_from("<HHI", self.data, 8 * k)
                if sym != FINAL and info & 0xFFFFFF >= self.count:
                    raise VfstError(f"transition {k} leads out of the table")

    def _record(self, k: int) -> tuple[int, int, int, int, int]:
        """(input, output, target, weight, further transitions)"""
        if self.weighted:
            i, o, target, weight, more, _ = struct.unpack_from("<IIIhBB", self.data, 16 * k)
            return i, o, target, weight, more
        i, o, info = struct.unpack_from("<HHI", self.data, 8 * k)
        return i, o, info & 0xFFFFFF, 0, info >> 24

    def arcs(self, state: int) -> list[tuple[int, int, int, int]]:
        """(input, output, target, weight) of a state. A count of 255 means that the second cell holds the count."""
        got = self.states.get(state)
        if got is None:
            got = []
            if state < self.count:
                more = self._record(state)[4]
                places = range(state, state + more + 1)
                if more == 255:
                    total = struct.unpack_from("<I", self.data, self.size * (state + 1))[0] if state + 1 < self.count else 0
                    places = [state, *range(state + 2, state + total + 2)]
                got = [self._record(k)[:4] for k in places if k < self.count]
            self.states[state] = got
        return got

    def encode(self, word: str) -> list[int]:
        """Symbol numbers; unknown characters get one that matches nothing."""
        nothing = len(self.symbols.strings)
        return [self.symbols.by_char.get(c, nothing) for c in word]

    def outputs(self, word: str, prefixes: bool = False) -> Iterator[tuple[str, int, int]]:
        """(output, weight, characters read) of every accepting path.

        ``prefixes`` accepts finals before the word's end. A search stops after
        STEP_LIMIT steps without an output or where it gets too deep.
        """
        s, text = self.symbols, self.encode(word)
        if self.weighted and any(c >= len(s.strings) for c in text):
            return
        values = [NEUTRAL] * len(s.features)
        path: list[tuple[Iterator, int, int, int, tuple[int, int] | None]] = []
        arcs, read, weight, steps = iter(self.arcs(0)), 0, 0, 0
        out: list[int] = []
        while True:
            for sym, produced, target, cost in arcs:
                if sym == self.final:
                    if read == len(text) or prefixes:
                        yield "".join(s.strings[o] for o in out), weight + cost, read
                        steps = 0
                    continue
                undo = None
                if sym < s.first_normal:
                    if sym and s.features:
                        flag = s.flags[sym] if sym < len(s.flags) else None
                        next_value = flag.apply(values[flag.feature]) if flag else None
                        if next_value is None:
                            continue
                        undo = (flag.feature, values[flag.feature])
                        values[flag.feature] = next_value
                    eaten = 0
                elif read < len(text) and text[read] == sym:
                    eaten = 1
                else:
                    continue
                if len(path) + 2 == BUFFER:
                    return
                path.append((arcs, eaten, cost, 0, undo))
                out.append(produced if produced >= s.first_normal else 0)
                read, weight, arcs = read + eaten, weight + cost, iter(self.arcs(target))
                steps += 1
                break
            else:
                if not path:
                    return
                arcs, eaten, cost, _, undo = path.pop()
                out.pop()
                read, weight = read - eaten, weight - cost
                if undo:
                    values[undo[0]] = undo[1]
                steps += 1
            if steps >= STEP_LIMIT:
                return

    def info(self) -> dict[str, object]:
        s = self.symbols
        return {"weighted": self.weighted, "transitions": self.count, "symbols": len(s.strings), "characters": len(s.by_char), "flag_features": len(s.features), "bytes": len(self.data)}


def build(symbols: list[str], states: list[list[tuple[str | None, str, int, int]]], weighted: bool = False) -> bytes:
    """A small dictionary for tests and tools.

    ``states`` holds arcs (input, output, target state, weight); input None is a
    final. Symbols are listed without the empty first one.
    """
    names = ["", *symbols]
    size = 16 if weighted else 8
    sizes = [len(a) + (len(a) > 255) for a in states]
    starts = [sum(sizes[:k]) for k in range(len(states))]
    out = struct.pack("<II", *MAGIC) + bytes([weighted]) + b"\0" * 7 + struct.pack("<H", len(names)) + b"".join(n.encode() + b"\0" for n in names)
    out += b"\0" * (-len(out) % size)
    for arcs in states:
        for k, (sym, produced, target, cost) in enumerate(arcs):
            more = 0 if k else min(255, len(arcs) - 1)
            i = (WEIGHTED_FINAL if weighted else FINAL) if sym is None else names.index(sym)
            o, to = (names.index(produced) if produced else 0), (0 if sym is None else starts[target])
            out += struct.pack("<IIIhBB", i, o, to, cost, more, 0) if weighted else struct.pack("<HHI", i, o, to | more << 24)
            if k == 0 and len(arcs) > 255:
                out += struct.pack("<I", len(arcs) - 1) + b"\0" * (size - 4)
    return out

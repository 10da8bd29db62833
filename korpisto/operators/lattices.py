"""Context rules and decoding of sentences.

A sentence is an array of words with an array of readings for each, so a rule that
asks for neighbours reads the places beside it, and nothing is shuffled. Rules are data:
a table of conditions on bits of the readings, which one Arrow function puts to all places
of many sentences at once, rule by rule. Decoding is a max-sum fold of built-in expressions
with back pointers; the first of equals wins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpisto.functions.chars import let
from korpisto.operators.disambiguation import BIGRAMS, N, RULES, UNSEEN, Bigrams
from korpisto.operators.readings import ATTRIBUTES

_NONE: tuple[str, ...] = ()


def conditions(rule: tuple) -> dict[str, object]:
    """A rule as what the facts of its place and of its neighbours must or must not hold."""
    kind, cls, *rest = rule
    out = {"keeps": kind.startswith("select"), "cls": cls, "left": _NONE, "right": _NONE, "here": _NONE, "not_left": False, "not_right": False, "first": False}

    def facts(name: str, values) -> tuple[str, ...]:
        return tuple(f"{name}={v}" for v in ((values,) if isinstance(values, str) else values))

    where = kind.split("_", 1)[1]
    if where == "first":
        out["first"] = True
    elif where == "if":
        out["here"] = facts(*rest)
    elif where == "for":
        out |= {"left": facts("CLASS", rest[0]), "here": facts("CLASS", rest[1])}
    elif where == "by_base":
        out["here"] = facts("BASEFORM", rest[0])
    elif where == "between":
        out |= {"left": facts("CLASS", rest[0]), "right": facts("CLASS", rest[1])}
    elif where == "after_base_before":
        out |= {"left": facts("BASEFORM", rest[0]), "right": facts("CLASS", rest[1])}
    elif where == "after_if":
        out |= {"left": facts("CLASS", rest[0]), "here": facts(*rest[1:])}
    else:
        side = "left" if "after" in where else "right"
        out |= {side: facts("BASEFORM" if where.endswith("base") else "CLASS", rest[0]), f"not_{side}": where.startswith("unless")}
    return out


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


class Facts:
    """The facts that rules ask for as bits of a few longs, so that asking a place is a bitwise and."""

    WORD = 62

    def __init__(self, rules: tuple) -> None:
        found = [conditions(r) for r in rules]
        self.rules = found
        asked = (f for c in found for f in (f"CLASS={c['cls']}", *c["left"], *c["here"], *c["right"]))
        self.bits = {f: k for k, f in enumerate(dict.fromkeys(asked))}
        self.masks = [f"m{k}" for k in range(-(-len(self.bits) // self.WORD) or 1)]

    def mask(self, wanted, k: int) -> int:
        return sum(1 << (self.bits[f] - k * self.WORD) for f in wanted if self.bits[f] // self.WORD == k)

    def of_reading(self, r: Column, attributes: tuple[str, ...]) -> list[Column]:
        out = []
        for k, name in enumerate(self.masks):
            mask = F.lit(0).cast("long")
            for a in dict.fromkeys(("CLASS", *attributes)):
                values = [f.split("=", 1)[1] for f in self.bits if f.startswith(f"{a}=") and self.bits[f] // self.WORD == k]
                if values:
                    at = F.array_position(F.expr(f"array({', '.join(map(_quoted, values))})"), r[a]).cast("int") - 1
                    bits = F.expr("array(" + ", ".join(f"{self.mask([f'{a}={v}'], k)}L" for v in values) + ")")
                    mask = mask.bitwiseOR(F.coalesce(F.get(bits, at), F.lit(0)))
            out.append(mask.alias(name))
        return out

    def table(self) -> list[tuple]:
        """The rules as (mask of the class: its number and bit, keeps, first, here, left, right); a side is its masks and what asking it must give, None if nothing is asked."""

        def side(c: dict[str, object], name: str) -> tuple | None:
            return ([self.mask(c[name], k) for k in range(len(self.masks))], not c.get(f"not_{name}", False)) if c[name] else None

        def cls(c: dict[str, object]) -> tuple[int, int]:
            k = self.bits[f"CLASS={c['cls']}"] // self.WORD
            return k, self.mask([f"CLASS={c['cls']}"], k)

        return [(*cls(c), c["keeps"], c["first"], side(c, "here"), side(c, "left"), side(c, "right")) for c in self.rules]


def _kept(table: list[tuple], rows: int = 1024):
    """Function of sentences, each reading as its masks, to the numbers of the readings that the rules leave.

    The places of ``rows`` sentences are one array, so a rule is a few array operations over all of
    them, and only the places that it may change are looked at further. Nothing here is imported by workers.
    """

    @F.arrow_udf("array<array<int>>")
    def kept(sets: pa.Array) -> pa.Array:
        def lengths(a: pa.Array) -> np.ndarray:
            return pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64)

        def of(part: pa.Array) -> pa.Array:
            per_sentence, places = lengths(part), part.flatten()
            sizes = lengths(places)
            ends = np.cumsum(sizes)
            starts = ends - sizes
            masks = [m.to_numpy(zero_copy_only=False) for m in places.flatten().flatten()]
            n, alive, filled = sizes.copy(), np.ones(len(masks[0]), bool), np.flatnonzero(sizes)
            facts = [np.zeros(len(sizes), np.int64) for _ in masks]  # of a place: those of all its readings left
            if filled.size:
                for f, m in zip(facts, masks):
                    f[filled] = np.bitwise_or.reduceat(m, starts[filled])
            sentence = np.repeat(np.arange(len(per_sentence)), per_sentence)
            begins = np.ones(len(sizes), bool)
            begins[1:] = sentence[1:] != sentence[:-1]
            last = np.roll(begins, -1)  # the first place begins a sentence, so the last one ends one

            def asked(at: np.ndarray, side: tuple, step: int) -> np.ndarray:
                wanted, answer = side
                to = np.clip(at + step, 0, len(sizes) - 1)
                held = np.zeros(len(at), bool)
                for f, w in zip(facts, wanted):
                    if w:
                        held |= (f[to] & w) != 0
                if step:
                    held &= ~(begins if step < 0 else last)[at]
                return held == answer

            for k, bit, keeps, first, here, left, right in table:
                at = np.flatnonzero(((facts[k] & bit) != 0) & (n > 1) & (begins if first else True))
                for side, step in ((here, 0), (left, -1), (right, 1)):
                    if side is not None and at.size:
                        at = at[asked(at, side, step)]
                if not at.size:
                    continue
                many = sizes[at]
                froms = np.cumsum(many) - many
                cells = np.arange(many.sum()) - np.repeat(froms - starts[at], many)
                was = alive[cells]
                stays = was & (((masks[k][cells] & bit) != 0) == keeps)
                some = np.add.reduceat(stays, froms, dtype=np.int64)
                stays |= was & np.repeat(some == 0, many)  # no place loses its last reading
                alive[cells] = stays
                n[at] = np.where(some > 0, some, n[at])
                for f, m in zip(facts, masks):
                    f[at] = np.bitwise_or.reduceat(np.where(stays, m[cells], 0), froms)

            def listed(sizes_: np.ndarray, values: pa.Array, **more) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes_))), pa.int32()), values, **more)

            numbers = np.arange(len(alive)) - np.repeat(starts, sizes)
            return listed(per_sentence, listed(n, pa.array(numbers[alive], pa.int32())), mask=part.is_null())

        return pa.concat_arrays([of(sets.slice(i, rows)) for i in range(0, len(sets), rows)] or [pa.array([], pa.list_(pa.list_(pa.int32())))])

    return kept


def pruned(sentence: Column, rules: tuple = RULES, attributes: tuple[str, ...] = ATTRIBUTES) -> Column:
    """The readings that the rules leave: each rule in turn, at all places at once; no place loses its last reading.

    ``attributes`` are the fields of a reading that rules may ask for, beside CLASS. Readings go
    to Python as their masks alone. ``sentence`` stands here twice, so it is best a plain column.
    """
    if not rules:
        return sentence
    facts = Facts(rules)
    none = F.array().cast("array<struct<" + ",".join(f"{n}:bigint" for n in facts.masks) + ">>")
    masked = F.transform(sentence, lambda readings: F.coalesce(F.transform(readings, lambda r: F.struct(*facts.of_reading(r, attributes))), none))
    return F.zip_with(sentence, _kept(facts.table())(masked), lambda readings, numbers: F.transform(numbers, lambda k: F.get(readings, k)))


def emission(words: Column, sentence: Column, *, same_base: float = 0.5, per_letter: float = 0.1, fields: tuple[str, ...] = ATTRIBUTES) -> Column:
    """Scores of readings for their words alone: weight, base form and length of the structure, as far as readings have them."""

    def score(word: Column, r: Column) -> Column:
        own = F.when((r["BASEFORM"] == word) & (word != ""), same_base).otherwise(0.0)
        if "STRUCTURE" in fields:
            own -= per_letter * F.greatest(F.lit(0), F.octet_length(F.coalesce(r["STRUCTURE"], F.lit(""))) - 1)
        weight = F.coalesce(r["WEIGHT"].try_cast("double"), F.lit(0.0)) if "WEIGHT" in fields else F.lit(0.0)
        return weight + own

    return F.transform(sentence, lambda readings, i: F.transform(readings, lambda r: score(F.get(words, i), r)))


def best_path(classes: Column, scores: Column, bigrams: Bigrams | None = None) -> Column:
    """The number of the chosen reading of each place; null if a place has none.

    ``classes`` and ``scores`` are arrays of arrays, one place each. A place keeps for
    each of its readings the best sum so far and where it came from.
    """
    weights, unseen = (bigrams.weights, bigrams.unseen) if bigrams else (BIGRAMS, UNSEEN)
    names = sorted({c for pair in weights for c in pair})
    matrix = F.expr("array(" + ", ".join("array(" + ", ".join(f"{float(weights.get((a, b), unseen))!r}D" for b in names) + ")" for a in names) + ")")
    rows, known = F.expr(f"array({', '.join(map(_quoted, names))})"), F.struct(matrix.alias("m"))
    ids = F.transform(classes, lambda p: F.transform(p, lambda c: F.array_position(rows, F.coalesce(c, F.lit(""))).cast("int") - 1))

    def step_weight(m: Column, a: Column, b: Column) -> Column:
        return F.coalesce(F.get(F.get(m, a), b), F.lit(float(unseen)))

    def fold(cells: Column, m: Column) -> Column:
        start = F.struct(F.lit(None).cast("array<int>").alias("ids"), F.lit(None).cast("array<double>").alias("best"), F.array().cast("array<array<int>>").alias("back"))

        def merge(acc: Column, cell: Column) -> Column:
            def reach(b: Column, k: Column) -> Column:
                came = F.array_max(F.transform(acc["best"], lambda v, a: F.struct((v + step_weight(m, F.get(acc["ids"], a), b)).alias("s"), (-a).alias("a"))))
                own = F.get(cell["scores"], k)
                return F.when(acc["best"].isNull(), F.struct(own.alias("s"), F.lit(0).alias("a"))).otherwise(F.struct((came["s"] + own).alias("s"), (-came["a"]).alias("a")))

            reached = F.transform(cell["ids"], reach)
            return let(reached, lambda r: F.struct(cell["ids"].alias("ids"), F.transform(r, lambda x: x["s"]).alias("best"), F.array_append(acc["back"], F.transform(r, lambda x: x["a"])).alias("back")))

        def trace(acc: Column) -> Column:
            last = -F.array_max(F.transform(acc["best"], lambda v, a: F.struct(v.alias("s"), (-a).alias("a"))))["a"]
            walk = F.aggregate(F.reverse(acc["back"]), F.struct(last.alias("at"), F.array().cast("array<int>").alias("path")), lambda t, came: F.struct(F.get(came, t["at"]).alias("at"), F.array_append(t["path"], t["at"]).alias("path")))
            return F.reverse(walk["path"])

        return F.aggregate(cells, start, merge, trace)

    cells = F.zip_with(ids, scores, lambda i, s: F.struct(i.alias("ids"), s.alias("scores")))
    path = let(known, lambda m: fold(cells, m["m"]))
    return F.when((F.size(classes) > 0) & F.forall(classes, lambda p: F.size(p) > 0), path)


def decoded(
    df: DataFrame, words: str = "words", readings: str = "readings", name: str = "best", *, rules: tuple = RULES, bigrams: Bigrams | None = None, oov: str = "null_all", fields: tuple[str, ...] = ATTRIBUTES,
    same_base: float = 0.5, per_letter: float = 0.1,
) -> DataFrame:
    """The input with one reading a word: rules, then the best path; no shuffle, and Python only for the rules.

    If a word has no reading, all words get null, or with ``oov="fallback"`` it is taken for a
    name or noun first. An empty sentence gives an empty array.
    """
    sentence = F.col(readings)
    if oov == "fallback":

        def guess(word: Column) -> Column:
            first = F.substring(word, 1, 1)
            upper = (first == F.upper(first)) & (first != F.lower(first))
            made = {"CLASS": F.when(upper, "etunimi").otherwise(N), "BASEFORM": F.lower(word)}
            return F.array(F.struct(*[made.get(a, F.lit(None)).cast("string").alias(a) for a in fields]))

        sentence = F.transform(sentence, lambda r, i: F.when(F.coalesce(F.size(r), F.lit(0)) > 0, r).otherwise(guess(F.get(words, i))))
    sentence = F.transform(sentence, lambda r: F.coalesce(r, F.array().cast("array<struct<" + ",".join(f"{a}:string" for a in fields) + ">>")))
    left = df.withColumn("_left", sentence).withColumn("_left", F.when(F.forall("_left", lambda p: F.size(p) > 0), pruned(F.col("_left"), rules, fields)))
    path = best_path(F.transform("_left", lambda p: F.transform(p, lambda r: r["CLASS"])), emission(F.col(words), F.col("_left"), same_base=same_base, per_letter=per_letter, fields=fields), bigrams)
    chosen = left.withColumn("_path", path)
    nothing = F.lit(None).cast("struct<" + ",".join(f"{a}:string" for a in fields) + ">")
    best = F.transform(words, lambda w, i: F.when(F.col("_path").isNotNull(), F.get(F.get("_left", i), F.get("_path", i))).otherwise(nothing))
    return chosen.withColumn(name, F.when(F.col(readings).isNotNull(), best)).drop("_left", "_path")

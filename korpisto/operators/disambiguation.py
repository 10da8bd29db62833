"""Disambiguation of sentences of readings: context rules, lattices, decoding.

Rules are data. A sentence is a row with its words and an array of readings for
each; one vectorised function prunes, scores and decodes it. Readings are
dictionaries of attributes, absent ones left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpisto.operators.evaluation import UPOS_OF_CLASS
from korpisto.operators.readings import ATTRIBUTES, READING

Reading = dict[str, str]
_ARROW_READING = pa.struct([(a, pa.string()) for a in ATTRIBUTES])

# Classes, the context rules in their order, and bigram weights.
N, V, A, ADV, PRON, NUM, ADP, NA = "nimisana", "teonsana", "laatusana", "seikkasana", "asemosana", "lukusana", "suhdesana", "nimisana_laatusana"
SUB = "alistuskonjunktio"
RULES = (
    ("select_after_base", V, ("ei",)),
    ("select_after_base", V, ("minä", "sinä", "hän", "me", "te", "he")),
    ("select_after_base", V, ("voida", "saattaa", "täytyä", "pitää", "joutua", "mahtaa", "taitaa", "aikoa")),
    ("remove_after", V, NUM), ("remove_after", V, A), ("select_before", NUM, N), ("select_before", NUM, "etunimi"), ("remove_first", ADP),
    ("remove_if", V, "SIJAMUOTO", "sisaolento"), ("remove_if", V, "SIJAMUOTO", "sisaeronto"), ("remove_if", V, "SIJAMUOTO", "ulkoolento"),
    ("remove_if", V, "SIJAMUOTO", "ulkoeronto"), ("remove_if", V, "SIJAMUOTO", "ulkotulento"), ("remove_if", V, "SIJAMUOTO", "tulento"),
    ("remove_if", V, "SIJAMUOTO", "sisatulento"), ("remove_if", V, "SIJAMUOTO", "olento"), ("remove_if", V, "SIJAMUOTO", "vajanto"),
    ("select_before", A, N), ("select_before", ADV, A), ("remove_if", ADV, "SIJAMUOTO", "omanto"), ("remove_if", V, "SIJAMUOTO", "osanto"),
    ("remove_if", N, "POSSIBLE_GEOGRAPHICAL_NAME", "true"), ("select_after", "etunimi", "etunimi"), ("select_after", "sukunimi", "etunimi"),
    ("select_if", A, "COMPARISON", "comparative"), ("select_if", A, "COMPARISON", "superlative"), ("remove_if", ADP, "SIJAMUOTO", "omanto"),
    ("remove_if", ADV, "SIJAMUOTO", "sisaolento"), ("remove_if", ADV, "SIJAMUOTO", "sisaeronto"), ("remove_if", ADV, "SIJAMUOTO", "osanto"),
    ("remove_if", ADV, "SIJAMUOTO", "sisatulento"), ("remove_if", ADV, "SIJAMUOTO", "ulkoolento"), ("remove_if", ADV, "PARTICIPLE", "past_passive"),
    ("select_after_base", V, ("joka", "mikä")),
    ("select_after_base", V, ("kun", "jos", "vaikka", "koska", "kunnes", "jotta", "ellei")),
    ("select_after_base", V, ("että",)), ("select_after_base", V, ("kuka", "ken")),
    ("select_if", V, "REQUIRE_FOLLOWING_VERB", "true"), ("select_if", V, "MOOD", "indicative"), ("select_if", V, "MOOD", "conditional"),
    ("select_if", V, "MOOD", "imperative"), ("select_if", V, "NEGATIVE", "true"), ("remove_first", "sukunimi"),
    ("select_by_base", SUB, ("koska", "kun", "jos", "vaikka", "kunnes", "jotta", "ellei", "ettei", "mikäli", "joskin")),
    ("select_by_base", SUB, ("että",)), ("remove_if", N, "PARTICIPLE", "present_active"), ("remove_if", N, "PARTICIPLE", "past_passive"),
    ("remove_if", ADV, "PARTICIPLE", "present_active"), ("remove_if", V, "SIJAMUOTO", "seuranto"), ("remove_if", V, "SIJAMUOTO", "kerrontosti"),
    ("remove_if", ADV, "SIJAMUOTO", "seuranto"), ("remove_after_if", ADV, N, "CLASS", ADP), ("remove_between", N, V, V), ("select_before", ADV, ADV),
    ("remove_after_if", V, ADV, "SIJAMUOTO", "omanto"), ("remove_after_if", V, ADV, "SIJAMUOTO", "osanto"),
    ("remove_if", ADV, "SIJAMUOTO", "tulento"), ("remove_if", ADV, "SIJAMUOTO", "ulkotulento"), ("remove_first", "etunimi"),
    ("select_by_base", ADP, ("lisäksi", "vuoksi", "puolesta", "keskellä", "kohdalla", "kautta", "perusteella", "sijaan")),
    ("select_before", NA, N), ("select_between", NA, PRON, N),
)
CONJ, NEG, INTJ = "sidesana", "kieltosana", "huudahdussana"
BIGRAMS = {
    (N, V): -0.3, (V, N): -0.5, (PRON, V): -0.3, (V, PRON): -0.9, (A, N): -0.2, (NUM, N): -0.4, (PRON, N): -0.6, (N, N): -0.8, (N, A): -1.5, (NUM, A): -1.2,
    (ADV, V): -0.5, (V, ADV): -0.6, (ADV, A): -0.7, (ADV, N): -0.8, (ADV, ADV): -1.0, (ADV, PRON): -1.2, (N, ADV): -1.0, (A, ADV): -1.3, (V, V): -0.7,
    (V, A): -0.7, (A, V): -0.9, (NUM, NUM): -1.0, (N, NUM): -1.5, (NUM, V): -0.8, (V, NUM): -1.3, (CONJ, N): -0.4, (CONJ, PRON): -0.5, (CONJ, V): -0.5,
    (CONJ, A): -0.6, (CONJ, ADV): -0.8, (CONJ, NUM): -0.9, (N, CONJ): -0.6, (V, CONJ): -0.7, (A, CONJ): -0.8, (ADV, CONJ): -1.0, (NUM, CONJ): -1.0,
    (N, ADP): -0.5, (ADP, N): -0.5, (PRON, ADP): -0.6, (ADP, V): -0.8, (ADP, PRON): -1.0, (NEG, V): -0.2, (NEG, A): -1.0, (NEG, N): -1.5, (N, NEG): -0.7,
    (PRON, NEG): -0.6, (ADV, NEG): -0.9, (CONJ, NEG): -0.7, (INTJ, N): -1.0, (INTJ, V): -1.0, (INTJ, PRON): -1.0, (INTJ, CONJ): -1.5, (PRON, PRON): -1.5,
    (PRON, A): -0.8, (PRON, ADV): -1.0, (PRON, CONJ): -1.2, (A, PRON): -1.5, (A, A): -1.2,
}
UNSEEN = -3.0
# End of fixed values.


# ------------------------------------------------------------------ context rules
def _has(readings: list[Reading] | None, name: str, values: tuple[str, ...]) -> bool:
    return any(r.get(name) in values for r in readings or ())


class Around:
    """What a rule may ask of a position: its own readings and its neighbours'."""

    def __init__(self, sentence: list[list[Reading]], i: int):
        self.here, self.first = sentence[i], i == 0
        self.left = sentence[i - 1] if i else None
        self.right = sentence[i + 1] if i + 1 < len(sentence) else None


#: Rule kind -> (whether the class is kept rather than dropped, condition on the rest of the rule).
KINDS: dict[str, tuple[bool, Callable[..., bool]]] = {
    "remove_after": (False, lambda x, p: _has(x.left, "CLASS", (p,))),
    "remove_unless_after": (False, lambda x, p: not _has(x.left, "CLASS", (p,))),
    "remove_before": (False, lambda x, f: _has(x.right, "CLASS", (f,))),
    "remove_unless_before": (False, lambda x, f: not _has(x.right, "CLASS", (f,))),
    "remove_for": (False, lambda x, p, other: _has(x.left, "CLASS", (p,)) and _has(x.here, "CLASS", (other,))),
    "remove_after_base": (False, lambda x, bases: _has(x.left, "BASEFORM", bases)),
    "remove_before_base": (False, lambda x, bases: _has(x.right, "BASEFORM", bases)),
    "remove_by_base": (False, lambda x, bases: _has(x.here, "BASEFORM", bases)),
    "remove_if": (False, lambda x, name, value: _has(x.here, name, (value,))),
    "remove_after_if": (False, lambda x, p, name, value: _has(x.left, "CLASS", (p,)) and _has(x.here, name, (value,))),
    "remove_between": (False, lambda x, p, f: _has(x.left, "CLASS", (p,)) and _has(x.right, "CLASS", (f,))),
    "remove_first": (False, lambda x: x.first),
    "select_after": (True, lambda x, p: _has(x.left, "CLASS", (p,))),
    "select_before": (True, lambda x, f: _has(x.right, "CLASS", (f,))),
    "select_unless_before": (True, lambda x, f: not _has(x.right, "CLASS", (f,))),
    "select_after_base": (True, lambda x, bases: _has(x.left, "BASEFORM", bases)),
    "select_before_base": (True, lambda x, bases: _has(x.right, "BASEFORM", bases)),
    "select_by_base": (True, lambda x, bases: _has(x.here, "BASEFORM", bases)),
    "select_if": (True, lambda x, name, value: _has(x.here, name, (value,))),
    "select_between": (True, lambda x, p, f: _has(x.left, "CLASS", (p,)) and _has(x.right, "CLASS", (f,))),
    "select_after_base_before": (True, lambda x, bases, f: _has(x.left, "BASEFORM", bases) and _has(x.right, "CLASS", (f,))),
    "select_first": (True, lambda x: x.first),
}


def prune(sentence: list[list[Reading]], rules: tuple = RULES) -> list[list[Reading]]:
    """Each rule in turn, at all positions at once; no position loses its last reading."""
    for kind, cls, *rest in rules:
        keeps, holds = KINDS[kind]
        after = []
        for i, readings in enumerate(sentence):
            if len(readings) > 1 and holds(Around(sentence, i), *rest):
                readings = [r for r in readings if (r.get("CLASS") == cls) == keeps] or readings
            after.append(readings)
        sentence = after
    return sentence


# --------------------------------------------------------------- scores, decoding
@dataclass
class Bigrams:
    weights: dict[tuple[str, str], float] = field(default_factory=lambda: dict(BIGRAMS))
    unseen: float = UNSEEN

    def __call__(self, left: Reading, right: Reading) -> float:
        return self.weights.get((left.get("CLASS") or "", right.get("CLASS") or ""), self.unseen)


@dataclass
class Emission:
    """Score of a reading for its word alone. ``priors`` is form -> tag -> probability."""

    same_base: float = 0.5
    per_letter: float = 0.1
    prior_weight: float = 2.0
    unseen: float = -3.0
    priors: dict[str, dict[str, float]] = field(default_factory=dict)

    def __call__(self, word: str, reading: Reading) -> float:
        score = self.same_base * (reading.get("BASEFORM") == word and bool(word)) - self.per_letter * max(0, len((reading.get("STRUCTURE") or "").encode()) - 1)
        known = self.priors.get("".join(c.lower()[:1] for c in word))
        if known is not None:
            p = known.get(UPOS_OF_CLASS.get(reading.get("CLASS") or "", "X"))
            score += self.prior_weight * math.log(p) if p else self.unseen
        return score


def viterbi(scores: list[list[float]], step: Callable[[int, int, int], float]) -> list[int]:
    """Indices of the best path; ``step(i, a, b)`` scores b at i after a. The first of equals wins. Empty if a node is."""
    if not scores or not all(scores):
        return []
    best, back = list(scores[0]), []
    for i in range(1, len(scores)):
        nexts, came = [], []
        for b, own in enumerate(scores[i]):
            options = [v + step(i, a, b) for a, v in enumerate(best)]
            a = max(range(len(options)), key=options.__getitem__)
            nexts.append(options[a] + own)
            came.append(a)
        best, back = nexts, [*back, came]
    path = [max(range(len(best)), key=best.__getitem__)]
    for came in reversed(back):
        path.append(came[path[-1]])
    return path[::-1]


@dataclass
class Tagger:
    """Decoding of whole sentences. ``extra(words)`` gives tag -> log probability for each word."""

    bigrams: Bigrams = field(default_factory=Bigrams)
    emission: Emission | None = field(default_factory=Emission)
    rules: tuple = RULES
    extra: Callable[[list[str]], list[dict[str, float]]] | None = None
    oov: str = "null_all"  # or "fallback": a word without readings gets a guess

    def decode(self, words: list[str], sentence: list[list[Reading]]) -> list[Reading | None]:
        if self.oov == "fallback":
            guess = lambda w: {"CLASS": "etunimi" if w[:1].isupper() else N, "BASEFORM": w.lower()}
            sentence = [r or [guess(w)] for w, r in zip(words, sentence)]
        if not sentence or not all(sentence):
            return [None] * len(words)
        sentence = prune(sentence, self.rules)
        if all(len(r) == 1 for r in sentence):
            return [r[0] for r in sentence]
        extra = self.extra(words) if self.extra else [{}] * len(words)
        scores = [
            [_weight(r) + (self.emission(w, r) if self.emission else 0.0) + x.get(UPOS_OF_CLASS.get(r.get("CLASS") or "", "X"), 0.0) for r in readings]
            for w, readings, x in zip(words, sentence, extra)
        ]
        path = viterbi(scores, lambda i, a, b: self.bigrams(sentence[i - 1][a], sentence[i][b]))
        return [readings[k] for readings, k in zip(sentence, path)]


def _weight(r: Reading) -> float:
    try:
        return float(r.get("WEIGHT") or 0)
    except ValueError:
        return 0.0


def _clean(sentence) -> list[list[Reading]]:
    return [[{k: v for k, v in r.items() if v is not None} for r in (readings if readings is not None else ())] for readings in sentence]


def disambiguate(df: DataFrame, words: str, readings: str, name: str = "best", tagger: Tagger | None = None) -> DataFrame:
    """The input with one reading (or null) a word, from an array of words and an array of their readings.

    Sentences become Python objects only where a tagger's probabilities or priors join the scores.
    """
    made = tagger or Tagger()
    if made.extra is None and made.emission is not None and not made.emission.priors:
        from korpisto.operators import lattices

        e = made.emission
        return lattices.decoded(df, words, readings, name, rules=made.rules, bigrams=made.bigrams, oov=made.oov, same_base=e.same_base, per_letter=e.per_letter)

    @F.arrow_udf(f"array<{READING}>")
    def decode(ws: pa.Array, rs: pa.Array) -> pa.Array:
        full = lambda r: None if r is None else {a: r.get(a) for a in ATTRIBUTES}
        rows = [[full(r) for r in made.decode(w, _clean(s))] if w is not None and s is not None else None for w, s in zip(ws.to_pylist(), rs.to_pylist())]
        return pa.array(rows, pa.list_(_ARROW_READING))

    return df.withColumn(name, decode(F.col(words), F.col(readings)))


def pruned(df: DataFrame, readings: str, name: str = "pruned", rules: tuple = RULES) -> DataFrame:
    """The input with the readings that the context rules leave."""
    from korpisto.operators import lattices

    return df.withColumn(name, lattices.pruned(F.col(readings), rules))


def tag(df: DataFrame, analyze: Callable[[Column], Column], text: str = "text", name: str = "tags", tagger: Tagger | None = None) -> DataFrame:
    """Tokenizes, analyses and decodes each text as one sentence: array of readings beside ``words``.

    ``analyze`` maps a column of words to readings. Words stay in their row, so there is
    no shuffle and no row number; a dictionary's analyzer remembers words it has seen.
    """
    from korpisto.operators.tokens import token_texts, token_type

    listed = df.withColumn("words", F.filter(token_texts(F.coalesce(F.col(text), F.lit(""))), lambda t: token_type(t) == "WORD"))
    of_lists = getattr(analyze, "of_lists", None)
    found = of_lists(F.col("words")) if of_lists else F.transform("words", analyze)
    return disambiguate(listed.withColumn("_sentence", found), "words", "_sentence", name, tagger).drop("_sentence")

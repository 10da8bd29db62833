"""Rules and decoding as column expressions against their plain versions."""

import random

from pyspark.sql import functions as F

from korpisto.operators import disambiguation as d
from korpisto.operators import lattices
from korpisto.operators.readings import ATTRIBUTES

FIELDS = ("CLASS", "BASEFORM", "SIJAMUOTO", "PARTICIPLE", "WEIGHT", "STRUCTURE")
SCHEMA = "n int, words array<string>, readings array<array<struct<" + ",".join(f"{f}:string" for f in FIELDS) + ">>>"
CLASSES = [d.N, d.V, d.A, d.ADV, d.PRON, d.NUM, d.ADP, d.NA, "etunimi", "sukunimi", d.SUB, None, "unheard"]
BASES = ["ei", "minä", "joka", "kun", "että", "lisäksi", "talo", None]


def made(count, seed):
    rng = random.Random(seed)

    def reading():
        return (rng.choice(CLASSES), rng.choice(BASES), rng.choice(["omanto", "sisaolento", "osanto", None]), rng.choice(["past_passive", None]), rng.choice(["0.5", "odd", None, "-1"]), rng.choice(["=ppp", None]))

    rows = []
    for n in range(count):
        size = rng.choice([0, 1, 2, 5, 9])
        words = [rng.choice(["talo", "ei", "", "Äiti", "x"]) for _ in range(size)]
        rows.append((n, words, [[reading() for _ in range(rng.choice([0, 1, 2, 3, 4] if n % 4 == 0 else [1, 2, 3]))] for _ in words]))
    return [*rows, (count, None, None)]


def clean(sentence):
    return [[{k: v for k, v in zip(FIELDS, r) if v is not None} for r in readings] for readings in sentence]


def dicts(sentence):
    return [[{k: v for k, v in r.asDict().items() if v is not None} for r in readings] for readings in sentence]


def every_kind():
    return tuple((kind, cls, *rest) for kind, cls, *rest in (
        ("remove_unless_after", d.V, d.N), ("remove_before", d.N, d.V), ("remove_unless_before", d.A, d.N), ("remove_for", d.V, d.N, d.ADV), ("remove_before_base", d.V, ("ei", "kun")), ("remove_by_base", d.PRON, ("joka",)),
        ("select_unless_before", d.N, d.V), ("select_before_base", d.V, ("ei",)), ("select_after_base_before", d.N, ("ei", "talo"), d.V), ("select_first", d.N), ("remove_after_base", d.V, ("talo",)),
    ))


def test_rules_leave_what_the_plain_version_leaves(spark):
    rows = made(150, 1)
    df = spark.createDataFrame(rows, SCHEMA)
    for rules in (d.RULES, every_kind(), ()):
        got = {r.n: r.k for r in df.select("n", lattices.pruned(F.col("readings"), rules, FIELDS).alias("k")).collect()}
        for n, _, sentence in rows:
            assert (got[n] is None) == (sentence is None)
            if sentence is not None:
                assert dicts(got[n]) == d.prune(clean(sentence), rules)


def test_paths_are_those_of_the_plain_version(spark):
    rows = made(150, 2)
    df = spark.createDataFrame(rows, SCHEMA)
    for rules, oov in ((d.RULES, "null_all"), ((), "null_all"), (d.RULES, "fallback")):
        got = {r.n: r.best for r in lattices.decoded(df, rules=rules, oov=oov, fields=FIELDS).collect()}
        tagger = d.Tagger(rules=rules, oov=oov)
        for n, words, sentence in rows:
            if sentence is None:
                assert got[n] is None
            else:
                assert [r and {k: v for k, v in r.asDict().items() if v is not None} for r in got[n]] == tagger.decode(words, clean(sentence))


def test_full_readings_go_the_same_way(spark):
    full = ", ".join(f"cast({v} as string) as {a}" for a, v in ((a, {"CLASS": "'teonsana'", "BASEFORM": "'x'"}.get(a, "null")) for a in ATTRIBUTES))
    df = spark.sql(f"select array('x', 'y') as words, array(array(struct({full})), array(struct({full}))) as readings")
    assert [r.CLASS for r in d.disambiguate(df, "words", "readings").first().best] == ["teonsana"] * 2
    assert [[r.CLASS for r in p] for p in d.pruned(df, "readings").first().pruned] == [["teonsana"]] * 2


def test_a_model_as_a_table_tags_as_the_matrix_does(spark):
    import numpy as np

    from korpisto.operators import tagger
    from korpisto.sources.codecs import TaggerModel

    rng = np.random.default_rng(2)
    sentences = [(n, ["Koira", "juoksee", "nopeasti", "koira", ".", "ja", "A-1"][: 1 + n % 7]) for n in range(20)] + [(20, [])]
    known = sorted({f for _, ws in sentences for i in range(len(ws)) for f in tagger.features(ws, i)})[::2]
    model = TaggerModel(["A", "B", "C"], {f: k for k, f in enumerate(known)}, np.array([0.0, 0.5, 0.0], np.float32), 0.25, rng.integers(-2, 3, (3, len(known))).astype(np.int8))
    got = tagger.tag_words_by_join(spark.createDataFrame(sentences, "n int, words array<string>"), model, ["n"]).collect()
    assert {(r.n, r.position): r["class"] for r in got} == {(n, i): c for n, ws in sentences for i, c in enumerate(tagger.best_classes(model, ws) if ws else [])}

"""Context rules are put to the places of many sentences at once."""

from pyspark.sql import functions as F

from korpisto.operators import disambiguation as d
from korpisto.operators import lattices
from tests.test_lattices import FIELDS, SCHEMA, clean, dicts, every_kind, made


def test_no_rule_is_folded_over_a_sentence_and_borders_of_batches_change_nothing(spark):
    rows = made(2600, 7)  # more than two parts of 1,024 sentences in one batch
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    for rules in (d.RULES, every_kind()):
        left = df.select("n", lattices.pruned(F.col("readings"), rules, FIELDS).alias("k"))
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" in plan and "aggregate(" not in plan
        got = {r.n: r.k for r in left.collect()}
        assert all(got[n] is None if s is None else dicts(got[n]) == d.prune(clean(s), rules) for n, _, s in rows)


def test_places_without_readings_stay_empty_and_no_sentences_give_none(spark):
    df = spark.createDataFrame([(0, [], [None, [], None]), (1, [], []), (2, [], None)], SCHEMA.replace("words", "w"))
    left = df.select("n", lattices.pruned(F.col("readings"), d.RULES, FIELDS).alias("k"))
    assert {r.n: r.k for r in left.collect()} == {0: [[], [], []], 1: [], 2: None}
    assert left.where("n > 2").collect() == []

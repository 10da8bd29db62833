"""A word's forms come from stems that are made once."""

from pyspark.sql import functions as F

from korpisto.functions import morphology

WORDS = ["", "a", "i", "V", "talo", "kauppa", "katu", "kenkä", "henki", "lahti", "AOU", "kukkA", "mattO", "pVtV", "tuntu\n", "ranta", "kissa", "vesi", "yö", "hyvä", "Pekka", "kuppi", "t", "pp", "appi", "ttA", "mmVl", "rugby", "sää", "x😀t", "nngp", "virta"]


def test_paradigms_are_those_of_single_forms(spark):
    frame = spark.createDataFrame([(w, 1) for w in WORDS] + [(None, 2)], "word string, more int")
    cells = F.array(*[morphology.noun_form(F.col("word"), c[1], n) for n in ("singular", "plural") for c in morphology.CASES])
    want = {(r.word, k, form) for r in frame.select("word", cells.alias("forms")).collect() for k, form in enumerate(r.forms)}
    got = morphology.noun_paradigm(frame)
    assert got.columns == ["word", "more", "position", "label", "form"]
    assert {(r.word, r.position, r.form) for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") < 40  # 22 forms graded each for itself had many more

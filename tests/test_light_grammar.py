"""Grammar rules look at the few words that they may find, and places are told for findings alone."""

from pyspark.sql import functions as F

from korpisto.operators import grammar, tokens
from tests.test_light_tokens import ODD_TEXTS


def test_words_behind_a_single_space_that_no_rule_names_are_left_out(spark):
    text = " ".join(f"sana{i}" for i in range(300)) + " sana299 ei, talo tämä kun"
    texts = tokens.token_texts(F.col("text"))
    frame = spark.createDataFrame([(text,)], "text string")
    assert [w.low for w in frame.select(grammar.words_with_context(texts, None).alias("w")).first().w] == ["sana0", "sana299", "ei", "talo", "kun"]
    assert "byte_start" not in grammar.grammar_check(frame)._jdf.queryExecution().optimizedPlan().toString()


def test_places_of_far_tokens(spark):
    """Byte offsets on both sides of every 64th token, and in a text of as many tokens."""
    texts = ["Ä " + "ö, ö " * n + "ja  ja" for n in (10, 15, 16, 21, 60, 200)]
    for r in grammar.grammar_check(spark.createDataFrame([(t,) for t in texts], "text string"), rules=("REPEATED_WORD", "DOUBLE_SPACE")).collect():
        n = len(r.text.encode())
        assert [(f.start, f.end, f.code) for f in r.findings] == [(n - 4, n - 2, "DOUBLE_SPACE"), (n - 2, n, "REPEATED_WORD")]
    far = "Talo. " + "vesi maa, " * 100 + "Kissa kissa"
    (found,) = grammar.grammar_check(spark.createDataFrame([(far,)], "text string"), rules=("REPEATED_WORD", "DOUBLE_NEGATION")).first().findings
    assert far[found.start : found.end] == "kissa" and found.end == len(far)


def test_words_are_told_as_by_their_type(spark):
    frame = spark.createDataFrame([(t,) for t in ODD_TEXTS], "text string").select(F.explode(tokens.token_texts(F.coalesce("text", F.lit("")))).alias("t"))
    rows = frame.select("t", tokens.is_word(F.col("t")).alias("word"), tokens.token_type(F.col("t")).alias("type")).collect()
    assert rows and all(r.word == (r.type == "WORD") for r in rows)

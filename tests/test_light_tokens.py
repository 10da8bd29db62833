"""Short ways to tokens, sentences and double spaces, held against the long ones."""

import random
import re

from pyspark.sql import functions as F

from korpisto.functions import chars
from korpisto.operators import grammar, tokens

ODD_TEXTS = [
    "Hän sanoi. \"No niin!\" Ja meni... pois, 3.5 km; v. 2020. Näin: se on. ", "a  b   c \n  d. e \t f  ", "", "http://a.fi/x?y=1, b@c.fi. d-e -f g-. h",
    "'t on \"se\", joka. \"Hei!\", hän. 5. luku esim. tämä?    x  y", "ﬀ Ɐb5 c5,5 1.2. x.y z:n \"  ' ) q", "12:30 ja klo 5 . . .... !? ?! … ja", "  ", "x", "ab cd, ef; gh: ij! kl\" \"mn op. qr",
]


def _plain_pattern():
    """The pattern of tokens without the short ways for plain words."""
    body = tokens.TOKEN[tokens.TOKEN.index("[\\-‐‑](?=[\\s\\S])"):]
    return body.replace("|\\.\\.\\.|", f"|[{chars.SPACE}]+|\\.\\.\\.|")


def test_short_ways_give_the_tokens_of_the_long_pattern(spark):
    """Plain words are told by what follows; addresses, numbers, hyphens and marks change nothing."""
    rng = random.Random(5)
    parts = ["a", "B", "ä", "Ɐ", "7", " ", " ", "\n", " ", ".", ",", ";", ":", "!", "?", "\"", "'", ")", "-", "‐", "@", "http://", "https://", "…", "”", "+", "ab", "12"]
    texts = [*ODD_TEXTS, *("".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(3000))]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    got = frame.select("text", tokens.token_texts(F.col("text")).alias("t"), F.regexp_extract_all("text", F.lit(_plain_pattern()), F.lit(0)).alias("w"), tokens.end_of_tokens(F.col("text")).alias("e"), F.regexp_extract_all("text", F.lit(tokens.STRETCH), F.lit(0)).alias("s")).collect()
    for r in got:
        assert r.t == r.w and "".join(r.t) == r.text == "".join(r.s)
        assert (r.e.characters, r.e.bytes) == (len(r.text), len(r.text.encode()))
        assert len(r.s) <= len(r.t)
    assert tokens.TOKEN != _plain_pattern()


def test_sentences_by_stretches_are_those_by_tokens(spark, monkeypatch):
    """Words that white space parts are one step of the fold: types and lengths stay as they are for single tokens."""
    rng = random.Random(6)
    parts = ["a", "Ab", "ä", "7", " ", " ", "\n", ".", ".", ",", ";", ":", "!", "?", "\"", "”", "“", "…", "...", "esim", "3.", "-", "B."]
    texts = [*ODD_TEXTS, *("".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(3000))]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.array(F.lit("esim.")).alias("known"))
    read = lambda: [(r.text, r.a, r.b) for r in frame.select("text", tokens.sentences(F.col("text")).alias("a"), tokens.sentences(F.col("text"), F.col("known")).alias("b")).collect()]
    got = read()
    assert "STRETCH" in vars(tokens)
    monkeypatch.setattr(tokens, "STRETCH", _plain_pattern())
    assert got == read()


def test_double_spaces_without_tokens(spark):
    """The rule alone gives what the whole check gives, at the places of runs of spaces only."""
    frame = spark.createDataFrame([(t,) for t in [*ODD_TEXTS, "a \n  b", "a  \n b", "ä  b     c", None]], "text string")
    alone = grammar.grammar_check(frame, rules=("DOUBLE_SPACE",))
    for r, every in zip(alone.collect(), grammar.grammar_check(frame).collect()):
        want = [(len(r.text[: m.start()].encode()), len(r.text[: m.end()].encode())) for m in re.finditer(f"[{chars.SPACE}]+", r.text or "") if set(m.group()) == {" "} and len(m.group()) > 1]
        assert [(f.start, f.end) for f in r.findings] == want and r.findings == [f for f in every.findings if f.code == "DOUBLE_SPACE"]
    plan = alone._jdf.queryExecution().optimizedPlan().toString()
    assert "http" not in plan  # no token is made

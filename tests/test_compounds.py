"""Compound splits by joins against the search of one word."""

import random

from korpisto.operators import compounds

LEXICON = ["rauta", "tie", "asema", "rautatie", "ihminen", "ihmis", "luonto", "kissa", "kissan", "pentu", "aa", "aaa", "äiti", "äitis", "yö", "työ", "on", "talo", "n"]


def made(seed):
    rng = random.Random(seed)
    words = {"", "-", "a-", "tie-asema", "tie-asema-talo", "tie-xx", "on-aa", "-tie", "ihmisenluonto", "kissanpentu", "aaaaaaaaa", "äitisentyö", "tie-" * 6 + "tie"}
    for _ in range(150):
        words.add("".join(rng.choice(LEXICON) + rng.choice(["", "", "en", "n", "s", "i"]) for _ in range(rng.randint(1, 6))))
    return sorted(words)


def test_splits_by_joins_are_those_of_the_search(spark):
    words = [*made(4), None, "tie-asema"]
    df = spark.createDataFrame([(w, "x", 1) for w in words], "word string, piece string, i int")
    lexicon = spark.createDataFrame([(w,) for w in [*LEXICON, "tie", None]], "word string")
    for options in ({}, {"rebuild": False}, {"dedup": True}, {"min_part": 2, "max_parts": 3}):
        search = {"rebuild": None} if options.get("rebuild") is False else {k: v for k, v in options.items() if k != "rebuild"}
        got = compounds.compound_split(df, lexicon, **options).collect()
        assert len(got) == len(words)
        for row in got:
            want = compounds.split_word(row.word, set(LEXICON).__contains__, **search) if row.word else []
            assert [([tuple(p) for p in s.parts], s.penalty) for s in row.splits] == want
    assert compounds.compound_split(df.limit(0), lexicon).collect() == []

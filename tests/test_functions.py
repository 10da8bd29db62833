"""Characters, hyphenation and morphology by golden vectors."""

import pytest
from pyspark.sql import functions as F

from korpisto.functions import chars, hyphenation, morphology


def column(spark, values, f):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, w string")
    return [r.x for r in rows.select("i", f(F.col("w")).alias("x")).orderBy("i").collect()]


def test_char_types(spark):
    got = column(spark, ["a", "Ä", "À", "5", " ", " ", ".", "»", "«", "@", "-"], chars.char_type)
    assert got == ["LETTER", "LETTER", "UNKNOWN", "DIGIT", "WHITESPACE", "WHITESPACE", "PUNCTUATION", "PUNCTUATION", "UNKNOWN", "UNKNOWN", "PUNCTUATION"]


def test_case(spark):
    words = ["A", "K2", "Hello", "hELLO", "abc", "123", "ABC", "", "McX"]
    assert column(spark, words, chars.case_type) == ["ALL_UPPER", "ALL_UPPER", "FIRST_UPPER", "COMPLEX", "ALL_LOWER", "NO_LETTERS", "ALL_UPPER", "NO_LETTERS", "COMPLEX"]
    assert column(spark, ["straße", "ÄITI"], chars.simple_upper) == ["STRASE", "ÄITI"]
    assert column(spark, ["İX", "ΣΑΣ"], chars.simple_lower) == ["ix", "σασ"]
    assert column(spark, ["hELLO", ""], lambda w: chars.set_case(w, F.lit("FIRST_UPPER"))) == ["Hello", ""]


def test_distances_count_bytes(spark):
    assert column(spark, ["talo", "tallö", ""], lambda w: chars.byte_levenshtein(w, F.lit("talo"))) == [0, 3, 4]


def test_shapes(spark):
    assert column(spark, ["Hello", "123", "U.S.A.", "aaBB-1"], chars.compressed_shape) == ["Xx", "d", "X.X.X.", "xX-d"]


def test_hyphenation(spark):
    want = ["suo-ma-lai-nen", "tie-to-ko-ne", "kir-ja-kaup-pa", "jal-ka-pal-lo", "aa-mu-pa-la", "äi-ti", "öl-jy", "yö", "grr", ""]
    assert column(spark, [w.replace("-", "") for w in want], hyphenation.hyphenate) == want
    assert column(spark, ["opettaja"], lambda w: hyphenation.hyphenate(w, 1)) == ["o-pet-ta-ja"]


@pytest.mark.parametrize("grade, pairs", [
    ("weak", {"kaappi": "kaapi", "katto": "kato", "kukka": "kuka", "kampa": "kamma", "ranta": "ranna", "kenkä": "kengä", "valta": "valla", "parta": "parra", "tapa": "tava", "katu": "kadu", "reikä": "reiä"}),
    ("strong", {"kamma": "kampa", "ranna": "ranta", "kengä": "kenkä", "valla": "valta", "parra": "parta", "tava": "tapa", "kadu": "katu"}),
])
def test_gradation(spark, grade, pairs):
    assert column(spark, list(pairs), lambda w: morphology.gradate(w, grade)) == list(pairs.values())


def test_harmony(spark):
    assert column(spark, ["talossA", "metsässA", "tiessA", "taloVn", "OssA"], lambda w: morphology.copy_vowel(morphology.harmonize(w))) == ["talossa", "metsässä", "tiessä", "taloon", "össä"]
    assert column(spark, ["kaappissA"], lambda w: morphology.morphophonology(w, "weak")) == ["kaapissa"]


def test_noun_forms(spark):
    form = lambda case, number="sg": column(spark, ["kaappi", "kaupunki", "ranta", "kukka", "talo"], lambda w: morphology.noun_form(w, case, number))
    assert form("genitive") == ["kaapin", "kaupungin", "rannan", "kukan", "talon"]
    assert form("osanto") == ["kaappia", "kaupunkia", "rantaa", "kukkaa", "taloa"]
    assert form("illative", "plural") == ["kaappeihin", "kaupunkeihin", "rantiin", "kukkiin", "taloihin"]
    assert form("nominative", "pl") == ["kaapit", "kaupungit", "rannat", "kukat", "talot"]
    assert form("nothing") == [None] * 5
    assert column(spark, ["sivu"], lambda w: morphology.noun_form(w, "partitive")) == ["sipua"]


def test_paradigms(spark):
    nouns = morphology.noun_paradigm(spark.createDataFrame([("talo",)], "word string")).orderBy("position").collect()
    assert len(nouns) == 22 and (nouns[0].label, nouns[0].form) == ("nominative sg", "talo") and nouns[12].form == "talojen"
    verbs = {(r.word, r.label): r.form for r in morphology.verb_paradigm(spark.createDataFrame([("puhua",), ("antaa",), ("ajatella",), ("xyz",)], "word string")).collect()}
    assert len(verbs) == 72
    assert [verbs["puhua", f"present {p}"] for p in morphology.PERSONS] == ["puhun", "puhut", "puhuu", "puhumme", "puhutte", "puhuvat"]
    assert verbs["antaa", "past 1sg"] == "annoin" and verbs["antaa", "past 3sg"] == "antoi" and verbs["ajatella", "present 3sg"] == "ajattelee"
    assert verbs["puhua", "neg present 3pl"] == "eivät puhu"
    past = morphology.verb_form(spark.createDataFrame([("antaa",)], "word string"), "word", "imperfect", "1sg", "neg").first()
    assert past.form == "en annanut"

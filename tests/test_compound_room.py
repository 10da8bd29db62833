"""Stretches of words are asked for only where a split has room."""

from korpisto.operators import compounds


def test_stretches_without_room_are_not_asked(spark):
    words = spark.createDataFrame([("rautatieasema",), ("tie",), ("rauta",), ("talotie",)], "word string")
    lexicon = spark.createDataFrame([("rauta",), ("tie",), ("asema",), ("rautatie",), ("rautatieasema",), ("talotie",), ("talo",), ("tal",), ("utatieasem",)], "piece string")
    got = {(r.word, r.i, r.j) for r in compounds._hits(words, lexicon, 3, True).collect()}
    assert got == {("rautatieasema", 0, 5), ("rautatieasema", 5, 8), ("rautatieasema", 8, 13), ("rautatieasema", 0, 8), ("talotie", 0, 4), ("talotie", 4, 7), ("talotie", 0, 3)}

"""Operator 6: which pairs of a group of near copies are verified first, and which only later."""

from korpisto.llm import op06_near_dedup as op6


def test_pairs_of_most_buckets_come_first(spark):
    """Of the pairs of a member, those come first whose sizes allow a link and that share the most buckets; the others where links leave them apart."""
    made = [(1, 9, True)] * 3 + [(2, 9, True)] * 5 + [(3, 9, True)] * 4 + [(4, 9, False)] * 7 + [(3, 8, True)]
    pairs = op6._likeliest(spark.createDataFrame(made, "a long, b long, fits boolean"))
    assert sorted((r.a, r.b, r.nth) for r in pairs.collect()) == [(1, 9, 3), (2, 9, 1), (3, 8, 1), (3, 9, 2), (4, 9, 4)]
    labels = spark.createDataFrame([(2, 2), (3, 2), (9, 2), (1, 1), (7, 1)], "key long, label long")
    asked = spark.createDataFrame([(1, 9), (3, 9), (2, 6), (5, 8)], "a long, b long")
    assert sorted(tuple(r) for r in op6._apart(asked, labels).collect()) == [(1, 9), (2, 6), (5, 8)]

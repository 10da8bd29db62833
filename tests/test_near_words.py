"""Near words by stretches against all distances."""

import random

import pytest

from korpisto.operators import spelling


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_near_words_of_every_length(spark, k):
    rng = random.Random(k)
    word = lambda: "".join(rng.choice("abä") for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 5, 7, 11])))
    queries, lexicon = {word() for _ in range(120)}, {word() for _ in range(160)}
    got = spelling.fuzzy_search(spark.createDataFrame([(q,) for q in [*queries, None]], "word string"), spark.createDataFrame([(w,) for w in [*lexicon, *lexicon, None]], "word string"), k).collect()
    want = {(q, w): d for q in queries for w in lexicon if (d := distance(q.encode(), w.encode())) <= k}
    assert {(r.query, r.candidate): r.distance for r in got} == want and len(got) == len(want)

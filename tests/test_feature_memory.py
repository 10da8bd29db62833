"""Counting the features of many distinct words keeps none of them in memory."""

import tracemalloc

import pyarrow as pa

from korpisto.operators import tagger


def test_memory_does_not_grow_with_distinct_words():
    def words(n):
        for first in range(0, n, 10_000):
            made = [f"sana{k}tusten" for k in range(first, first + 10_000)]
            yield pa.RecordBatch.from_arrays([pa.array(made)] + [pa.array([1] * len(made))] * 5, names=["word", "own", "prev", "next", "prev2", "next2"])

    tracemalloc.start()
    total = sum(sum(b.column(1).to_pylist()) for b in tagger.word_feature_counts(words(20_000)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total > 20_000 * 20 and peak < 10e6

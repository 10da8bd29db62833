"""Operator 10's forest and threshold come from all labelled rows."""

import numpy as np

from korpisto.llm import op10_quality as op10
from korpisto.session import ship


def test_every_labelled_row_counts(spark):
    ship(spark)
    rng = np.random.default_rng(4)
    words = np.array(["sana", "toinen", "pitkähkö", "a", "kuusi", "#x", "mitä?"])
    rows = [(i, " ".join(rng.choice(words, 24, p=[0.3, 0.2, 0.2, 0.1, 0.1, 0.05, 0.05])) + " ##" * (10 * (i % 40 == 0))) for i in range(9000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame([(i, int(i % 40 != 0)) for i in range(9000)], "doc_id long, quality int")
    stats = op10.rule_statistics(frame).toPandas()
    stats = stats[(stats.n_words >= 20) & (100 * stats.n_repeat_words <= 30 * stats.n_words)]
    x, good = op10.features({s: stats[s].to_numpy() for s in op10.STATS}), (stats.doc_id % 40 != 0).to_numpy()
    assert good.sum() > 8192
    whole = op10.drawn((x.min(0), x.max(0)), 8, op10.deepest_of(32, int(good.sum())), 5)
    counts = op10.leaf_counts(whole, x[good])
    assert (counts.sum(1) == good.sum()).all()
    forest, limit = op10.fit(frame, marks, trees=8, points=32, spare=0.005, seed=5)
    want = op10.grow(x[good], (x.min(0), x.max(0)), 8, 32, 5)
    assert all(np.array_equal(forest[k], want[k]) for k in want)
    own = op10.scores(op10.built(whole, counts, 32, 1), x[good]) / op10.GRID
    assert limit == op10.threshold_of(own, op10.scores(want, x[~good]) / op10.GRID, 0.005)
    judged = op10.judge(frame, marks, trees=8, points=32, seed=5).where("not base_failed").toPandas()
    assert (judged.kept == (judged.anomaly <= limit)).all() and 0 < (~judged.kept).sum()


def test_a_row_is_judged_without_its_own_count():
    x = np.array([[k % 7 * 1.0, k % 5 * 1.0, 0, 0, 0, 0] for k in range(70)])
    whole = op10.drawn((x.min(0), x.max(0)), 6, op10.deepest_of(16, 70), 1)
    less = op10.built(whole, op10.leaf_counts(whole, x), 16, 1)
    for k in (0, 13, 69):
        others = op10.built(whole, op10.leaf_counts(whole, np.delete(x, k, 0)), 16)
        assert op10.anomaly(less, x[k : k + 1]) == op10.anomaly(others, x[k : k + 1])

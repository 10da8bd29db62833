"""Operator 13 against all products."""

import math

import numpy as np
import pytest

from korpisto.llm import op13_hard_negatives as op13
from korpisto.llm import queries
from korpisto.session import ship

SCHEMA = "vec_id long, embedding array<float>, label int, key string, score long"


def plain(rows, positives=5, negatives=10, low=30, high=90):
    ok = [(i, [math.floor(256 * x) for x in v], y) for i, v, y, *_ in rows if v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, a, y) in enumerate(ok):
        if i is None or i % 100:
            continue
        scored = [(-sum(p * q for p, q in zip(a, v)), math.inf if j is None else j, m, z) for m, (j, v, z) in enumerate(ok) if m != n and len(v) == len(a)]
        scored.sort()
        for s, j, m, _ in [x for x in scored if x[3] == y][:positives]:
            fits = [x for x in scored if x[3] != y and low * -s <= 100 * -x[0] <= high * -s]
            out += [(i, None if j == math.inf else j, k + 1, None if x[1] == math.inf else x[1], -s, -x[0]) for k, x in enumerate(fits[:negatives])]
    return out


def made(seed, n, dim, scale=1.0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)) * scale / dim**0.5
    v[n // 3 :: 3] = v[0] + rng.normal(size=v[n // 3 :: 3].shape) * 0.02 * scale  # a third of the rows are near copies
    v[5::50] = v[5]
    ids = list(range(n))
    rows = [(ids[k], [float(np.float32(x)) for x in v[k]], int(rng.integers(0, 4)), "x", 1) for k in range(n)]
    rows += [(100, rows[7][1], 2, "x", 1), (None, rows[3][1], 1, "x", 1), (700, None, 1, "x", 1), (800, rows[3][1], None, "x", 1), (n + 1, [None] + rows[1][1][1:], 1, "x", 1)]
    rows += [(n + 2, [float("nan")] + rows[1][1][1:], 1, "x", 1), (n + 3, [1.0, 2.0], 1, "x", 1), (900, [], 1, "x", 1), (n + 4, [0.0] * dim, 2, "x", 1), (1000, [0.0] * dim, 3, "x", 1)]
    return rows


@pytest.mark.parametrize("seed,dim,scale,tile,part_rows", [(1, 16, 1.0, 4096, 1 << 16), (2, 7, 30.0, 17, 100), (3, 64, 1.0, 64, 50), (4, 3, 70000.0, 33, 1000)])
def test_hard_negatives_match_all_products(spark, seed, dim, scale, tile, part_rows):
    ship(spark)
    rows = made(seed, 450, dim, scale)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [tuple(r) for r in op13.hard_negatives(df, is_anchor="id % 100 = 0", tile=tile, part_rows=part_rows).collect()]
    order = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=order) == sorted(plain(rows), key=order) and len(got) > 50


def test_empty_table(spark):
    assert op13.hard_negatives(spark.createDataFrame([], SCHEMA), is_anchor="id % 100 = 0").collect() == []


def test_bit_planes_drop_candidates_early():
    rng = np.random.default_rng(0)
    q, a = rng.integers(-200, 200, (4000, 64)), rng.integers(-200, 200, (8, 64))
    left = []

    def prune(low, high, col, alive):
        exact = q @ a.T
        if alive is not None:
            assert (low <= exact).all() and (exact <= high).all()
        stay = high >= 300_000
        left.append(int((stay & (alive if alive is not None else True)).sum()))
        return stay

    r, c, s = op13.sliced(op13.Tile(q), a, np.ones((4000, 8), bool), prune)
    assert sorted(zip(r, c)) == sorted(zip(*np.nonzero(q @ a.T >= 300_000))) and (s == (q @ a.T)[r, c]).all()
    assert left[0] == 32000 and left[4] < 16000 and left == sorted(left, reverse=True)


def test_sql_gives_the_same(spark):
    import duckdb

    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    columns = "anchor_id, positive_id, rank, negative_id, positive_score, negative_score"
    want = con.execute(f"select {columns} from ({queries.ORACLES['op13_hard_negatives']}) order by all").fetchall()
    assert sorted(tuple(r) for r in queries.op13_hard_negatives_(spark, folder).select(*columns.split(", ")).collect()) == want and want

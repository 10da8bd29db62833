"""Operator 11 against all cosines."""

import numpy as np
import pytest

from korpisto.llm import op11_embedding_dedup as op11
from korpisto.llm import queries
from korpisto.session import ship

SCHEMA = "vec_id long, embedding array<float>, label int, key string, dim string, q string"


def plain(rows, least=0.95):
    ok = {}
    for n, (i, v, *_) in enumerate(rows):
        if v is not None and None not in v and np.isfinite(v).all() and any(v):
            ok.setdefault(len(v), []).append(n)
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for at in ok.values():
        m = np.array([rows[n][1] for n in at], np.float64)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        near = m @ m.T >= least
        np.fill_diagonal(near, False)
        for a, b in zip(*np.nonzero(near)):
            links[at[a]] += 1
            root[find(at[a])] = find(at[b])
    low = {}
    for n, row in enumerate(rows):
        if row[0] is not None:
            low[find(n)] = min(low.get(find(n), row[0]), row[0])
    return [(row[0], links[n], low.get(find(n)), row[0] == low.get(find(n))) for n, row in enumerate(rows)]


def made(seed, n, dim):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    third = n // 3
    v[:third] = v[0] + rng.normal(size=(third, dim)) * 0.08 / dim**0.5  # dense: one ball
    v[third : third + 60] = v[third] + rng.normal(size=(60, dim)) * 0.32 / dim**0.5  # at the threshold: pair by pair
    for k in range(40):  # a chain
        v[third + 60 + k] = v[third + 59 + k] + rng.normal(size=dim) * 0.22 / dim**0.5
    v[third + 100 : third + 160] = v[third + 100]
    v *= rng.uniform(0.1, 20, size=(n, 1))
    ids = rng.permutation(n) * 3
    rows = [(int(ids[k]), [float(np.float32(x)) for x in v[k]]) for k in range(n)]
    rows += [(None, rows[1][1]), (1, None), (2, []), (4, [0.0] * dim), (5, [None] + rows[3][1][1:]), (7, [float("inf")] + rows[3][1][1:]), (8, [1.0, 2.0]), (10, [2.0, 4.0]), (rows[2][0], rows[2][1]), (11, [3e38] * dim), (13, [1e-38] * dim)]
    return [(*r, 1, "x", "y", "z") for r in rows]


def order(r):
    return tuple((x is None, x or 0) for x in r)


@pytest.mark.parametrize("seed,n,dim,block,size", [(1, 700, 32, 2048, 256), (2, 600, 64, 40, 8)])
def test_links_and_components_match_all_cosines(spark, seed, n, dim, block, size):
    ship(spark)
    rows = made(seed, n, dim)
    got = [tuple(r) for r in op11.embedding_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3), block=block, size=size).collect()]
    assert sorted(got, key=order) == sorted(plain(rows), key=order)
    assert max(r[1] for r in got) > n / 3


def test_empty_table(spark):
    assert op11.embedding_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_recall_of_random_pairs_at_the_threshold():
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    points = unit(rng.normal(size=(1024, 64)))
    x = unit(rng.normal(size=(3000, 64)))
    z = rng.normal(size=x.shape)
    z = unit(z - (z * x).sum(1, keepdims=True) * x)
    a, b = (op11.pivot_pairs(op11.nearest(m, points, op11.NEAREST), 64, 1024) for m in (x, 0.95 * x + (1 - 0.95**2) ** 0.5 * z))
    found = np.mean([bool(np.intersect1d(p, q).size) for p, q in zip(a, b)])
    assert found > 0.99


def test_sql_gives_the_same(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("create view embeddings as select * from '/root/testdata/sf0.01/embeddings.parquet'")
    want = con.execute(f"select vec_id, n_links, component_id, kept from ({queries.ORACLES['op11_embedding_dedup']}) order by all").fetchall()
    assert sorted(tuple(r) for r in queries.op11_embedding_dedup_(spark, "/root/testdata/sf0.01").collect()) == want

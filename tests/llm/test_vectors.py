import numpy as np
import pytest

from wardgate.llm import vectors
from wardgate.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute(rows, threshold):
    """{vec_id: (links, component)} for rows of distinct ids."""
    ok = [
        (i, np.array(v, float), g)
        for i, v, g in rows
        if g is not None and v and all(e is not None and np.isfinite(e) for e in v) and any(v)
    ]
    low = {i: i for i, _, _ in rows}
    links = dict.fromkeys(low, 0)
    root = lambda i: i if low[i] == i else root(low[i])
    for g in {(len(v), g) for _, v, g in ok}:
        ids = [i for i, v, h in ok if (len(v), h) == g]
        x = np.array([v / np.linalg.norm(v) for _, v, h in ok if (len(v), h) == g])
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= threshold, 1)), strict=True):
            links[ids[a]] += 1
            links[ids[b]] += 1
            p, q = root(ids[a]), root(ids[b])
            low[max(p, q)] = min(p, q)
    return {i: (links[i], root(i)) for i in low}


def planted(seed, n=900, dim=24):
    """Random vectors of two labels with copies, near copies and one tight cluster of a third of a label."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x[100:200] = x[rng.integers(0, 100, 100)] + 0.1 * rng.standard_normal((100, dim))
    x[200:350] = x[0] + 0.12 * rng.standard_normal((150, dim))
    x[350:380] = x[5]
    order = rng.permutation(n)
    return [(int(i), x[k].tolist(), int(k % 7 == 3)) for i, k in enumerate(order)]


def collect(df):
    rows = df.collect()
    out = {r.vec_id: (r.n_links, r.component_id) for r in rows}
    assert len(out) == len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)
    return out


@pytest.mark.parametrize("shard,overlap", [(4096, 3), (150, 4)])
def test_planted_groups(spark, shard, overlap):
    """With small shards the cells are split over pivots, and the tight cluster over blocks."""
    rows = planted(1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = collect(vectors.near_duplicates(df, 0.93, shard=shard, overlap=overlap))
    want = brute(rows, 0.93)
    assert set(got) == set(want)
    found, true = sum(min(got[i][0], want[i][0]) for i in want), sum(v[0] for v in want.values())
    assert found >= 0.97 * true
    assert all(got[i][0] <= want[i][0] for i in want)
    assert np.mean([got[i][1] == want[i][1] for i in want]) > 0.97


def test_a_pair_in_several_shards_counts_once(spark):
    """Every pair of blocks is a shard, so the count must be exact where the search is."""
    rows = [(i, [1.0, 0.001 * i], 0) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = collect(vectors.near_duplicates(df, 0.93, shard=16, overlap=2))
    assert got == brute(rows, 0.93)


def test_pruning_keeps_no_dominated_candidate():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((50, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    cand = np.argsort(-s, axis=1)[:, 1:20]
    a, b = vectors._pruned(x, np.arange(50), cand, np.take_along_axis(s, cand, 1), 6)
    for i in range(50):
        kept = b[a == i].tolist()
        assert kept[0] == cand[i, 0] and 1 <= len(kept) <= 6
        for k, j in enumerate(kept):
            assert all(vectors.ALPHA * (1 - s[m, j]) > 1 - s[i, j] - 1e-5 for m in kept[:k])


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], None), (4, None, 0), (5, [0.0, 0.0], 0), (6, [nan, 1.0], 0),
            (7, [inf, 1.0], 0), (8, [None, 1.0], 0), (9, [], 0), (10, [1.0, 0.0], 0), (11, [-1.0, -0.0], 0), (12, [1.0, 0.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as id", "2 as cell")
    got = collect(vectors.near_duplicates(df, 0.93))
    assert got == {1: (2, 1), 2: (2, 1), 10: (2, 1)} | {i: (0, i) for i in (3, 4, 5, 6, 7, 8, 9, 11, 12)}
    assert vectors.near_duplicates(df.limit(0), 0.93).collect() == []


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert collect(QUERIES["op7_embeddings"](spark, SF)) == brute(rows, 0.93)

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardgate.llm import topk
from wardgate.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute(rows, k, wanted):
    """{query id: [(vec_id, score)]} by scoring every row."""
    ints = [(i, np.floor(1024.0 * np.asarray(v, float)).astype(int)) for i, v in rows]
    out = {}
    for i, q in ints:
        if wanted(i):
            scored = sorted((-int(q @ v), j) for j, v in ints if j != i)
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("segment,block,query", [(16384, 128, 4096), (40, 7, 5)])
def test_random_vectors_with_ties(spark, segment, block, query, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "BOUNDS_AT_A_TIME", 3)
    rng = np.random.default_rng(9)
    v = np.round(rng.standard_normal((300, 6)) * 2) / 16
    v[200:260] = v[0]  # ties
    rows = [(int(i * 3), v[i].tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    wanted = F.col("vec_id") % 10 == 0
    got = found(topk.search(df, wanted, segment_rows=segment, query_rows=query))
    assert got == brute(rows, 10, lambda i: i % 10 == 0)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (1, None, 1), (2, [nan, 1.0], 1), (3, [inf, 1.0], 1), (4, [None, 1.0], 1), (5, [], 1),
            (6, [-1.0, 0.5], 1), (7, [1.0, 2.0, 3.0], 1), (None, [1.0, 1.0], 1), (100, [0.5, -2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    q = F.col("vec_id") % 100 == 0
    got = found(topk.search(df, q))
    assert got == {0: [(6, 0), (100, -3670016)], 100: [(6, -1572864), (0, -3670016)]}
    assert topk.search(df.limit(0), q).collect() == []
    assert topk.search(df.where("vec_id = 0"), q).collect() == []


def test_query_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert found(QUERIES["op9_topk"](spark, SF)) == brute(rows, 10, lambda i: i % 100 == 0)

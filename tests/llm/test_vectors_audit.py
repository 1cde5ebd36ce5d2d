import numpy as np

from test_vectors import brute, collect
from wardgate.llm import vectors


def scattered(seed=2, dim=64):
    """600 scattered pairs near the threshold, which a tight cluster outnumbers in links."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((600, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.standard_normal((600, dim))
    noise -= (noise * x).sum(axis=1, keepdims=True) * x
    y = 0.935 * x + np.sqrt(1 - 0.935**2) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    tight = x[0] + 0.02 * rng.standard_normal((150, dim))
    both = np.concatenate([x, y, tight])
    return [(int(i), both[k].tolist(), 0) for i, k in enumerate(rng.permutation(len(both)))]


def test_scattered_pairs_beside_a_tight_cluster(spark):
    rows = scattered()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got, want = collect(vectors.near_duplicates(df, 0.93, shard=100, overlap=1)), brute(rows, 0.93)
    share = [min(got[i][0], n) / n for i, (n, _) in want.items() if 0 < n <= vectors.FEW]
    assert len(share) > 1000 and np.mean(share) >= vectors.ENOUGH
    assert all(got[i][0] <= want[i][0] for i in want)


def test_what_stays_short_is_searched_exactly(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BUILDS", 1)
    monkeypatch.setattr(vectors, "audited", lambda *a: [(200, 0.5), (0, 1.0)])
    rows = scattered()[:500]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert collect(vectors.near_duplicates(df, 0.93, shard=100, overlap=1)) == brute(rows, 0.93)

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from wardgate.llm import substrings as sub
from wardgate.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(texts, m):
    """(bytes, removed, spans, digest of what is left) of each text, by counting every string of m bytes."""
    datas = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + m] for d in datas for i in range(len(d) - m + 1))
    out = []
    for d in datas:
        gone = np.zeros(len(d) + 1, int)
        for i in range(len(d) - m + 1):
            if seen[d[i : i + m]] > 1:
                gone[i] += 1
                gone[min(len(d), i + m)] -= 1
        gone = np.cumsum(gone)[: len(d)] > 0
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def fixture(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "and", "é", "ba", "x"]) + rng.choice("abc") * rng.randrange(3)
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(40) for _ in range(4)]
    texts = [text(rng.randrange(60)) for _ in range(30)]
    for _ in range(40):
        parts = [text(rng.randrange(12)), rng.choice(shared), text(rng.randrange(8)), rng.choice(shared)[rng.randrange(50) :]]
        texts.append(" ".join(parts))
    base = text(90)
    for _ in range(40):  # near copies
        w = base.split()
        w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += [base] * 5 + [None, "", "a", "ab" * 200, "z" * 300, "z" * 64, text(70) * 3]
    rng.shuffle(texts)
    return texts


def as_rows(spark, texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in sub.digests(df, **how).collect()}
    return [got[i] for i in range(len(texts))]


@pytest.mark.parametrize("blocks", [4096, 7, 1])
@pytest.mark.parametrize("seed", range(10))
def test_suffix_array_and_prefixes(seed, blocks, monkeypatch):
    monkeypatch.setattr(sub, "KASAI_BLOCKS", blocks)
    rng = np.random.default_rng(seed)
    low, letters = (97, (1, 2, 4, 26)[seed % 4]) if seed < 8 else (0, 2)  # also bytes zero
    data = rng.integers(low, low + letters, 700).astype(np.uint8)
    data[300:450] = data[100:250]
    text = data.tobytes()
    order = sub.suffix_array(data)
    assert order.tolist() == sorted(range(len(data)), key=lambda i: text[i:])
    want = [0]
    for a, b in zip(order, order[1:], strict=False):
        k = 0
        while k < 40 and max(a, b) + k < len(text) and text[a + k] == text[b + k]:
            k += 1
        want.append(k)
    assert sub.common_prefixes(data, order, 40).tolist() == want


def test_equal_windows_have_equal_anchors(monkeypatch):
    rng = random.Random(2)
    data = "".join(rng.choice("abcd ") for _ in range(3000)).encode()
    whole = sub.runs(data, 64)
    anchor = {s + i: a for s, n, a, _ in whole for i in range(n)}
    assert sorted(anchor) == list(range(len(data) - 63))
    moved = {s + i: a for s, n, a, _ in sub.runs(b"zz" + data, 64) for i in range(n)}
    assert all(moved[i + 2] == a for i, a in anchor.items())
    monkeypatch.setattr(sub, "SLICE", 100)
    assert {s + i: a for s, n, a, _ in sub.runs(data, 64) for i in range(n)} == anchor


def test_merging_by_binary_search():
    runs_ = [np.array(x, "S16") for x in (["a", "c", "e"], ["b", "c"], [], ["a", "c", "d"])]
    assert [f.tolist() for f in sub.merged_repeats(runs_)] == [
        [True, True, False], [False, True], [], [True, True, False],
    ]


@pytest.mark.parametrize("shard_bytes", [6 << 20, 1500, 300])
def test_fixture_equals_brute_force(spark, shard_bytes, monkeypatch):
    """Small shards split the anchors of the near copies, so the merge across shards takes part."""
    monkeypatch.setattr(sub, "KASAI_BLOCKS", 7)
    texts = fixture(1)
    assert as_rows(spark, texts, min_bytes=64, shard_bytes=shard_bytes) == brute(texts, 64)


def test_edges(spark):
    rows = [(1, "é" * 300, "x", 1), (1, "é" * 300, "x", 1), (None, "q" * 399, "y", 2), (2, None, "z", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, cut string, key int")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in sub.digests(df).collect())
    assert got == [(0, 399, 0, 0), (1, 600, 600, 1), (1, 600, 600, 1), (2, 0, 0, 0)]
    assert set(sub.removed(df).columns) == {"doc_id", "text", "cut", "key"}
    assert sub.digests(df.limit(0)).collect() == []


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op6_substrings"](spark, SF).collect()}
    assert got == dict(zip([r.doc_id for r in rows], brute([r.text for r in rows], 400), strict=True))

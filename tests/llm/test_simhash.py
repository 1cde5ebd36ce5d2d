import random

import numpy as np
import pytest
import xxhash

from wardgate.llm import simhash
from wardgate.llm.components import components
from wardgate.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    """{doc: smallest doc reachable} by comparing all pairs."""
    ids = sorted(prints)
    low = {i: i for i in ids}
    root = lambda i: i if low[i] == i else root(low[i])
    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = root(i), root(j)
                low[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_code_is_perfect():
    words = simhash.CORRECTIONS
    assert len(set(words)) == 2048 and max(int(w).bit_count() for w in words) == 3


def test_words_two_bits_apart_share_a_key():
    rng = random.Random(5)
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a
        for _ in range(rng.randrange(3)):
            b ^= 1 << rng.randrange(64)
        pair = np.array([a, b], np.uint64)
        at, key = simhash.keys(pair)
        assert set(key[at == 0]) & set(key[at == 1])
        assert len(key) <= 36


@pytest.mark.parametrize("text", [None, "", " \t ", "One", "One two", "A b\x0bC d É\xa0e", "x " * 70_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("most", [64, 2])
def test_components_of_clusters(spark, most):
    """With ``most`` 2 nearly every key takes the way for tight clusters."""
    rng = random.Random(6)
    prints = []
    for _ in range(12):
        a = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 25)):
            prints.append(a)
            for _ in range(rng.randrange(4)):
                a ^= 1 << rng.randrange(64)
    prints = list(dict.fromkeys(prints))
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(i,) for i in signed], "fp long")
    got = {r.node: r.component for r in components(simhash._links(df, most)).collect()}
    want = plain_components(dict(enumerate(prints)))
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert groups({i: got.get(s, s) for i, s in enumerate(signed)}) == groups(want)


def test_components_of_paths(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 100), (7, 7), (200, 150), (150, 160), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 100: 90, 200: 150, 150: 150, 160: 150}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(3, None, "a", 1), (1, "", "b", 2), (2, "x y z", "c", 3)], "doc_id long, text string, fingerprint string, component long")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got[1] == got[3] == ("0" * 16, 1)
    assert got[2][1] == 2
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def test_query_equals_all_pairs(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = plain_components(prints)
    got = QUERIES["op2_simhash"](spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in texts}
    assert len(got) == len(texts)

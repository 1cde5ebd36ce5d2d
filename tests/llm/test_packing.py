import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wardgate.llm import packing
from wardgate.llm.queries import QUERIES

FILE = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.01"
PARTS = ["<|endoftext|>", " ", "'s", "a", "É", "é", "́", "1", "²", ".", ",", "\n", "\x1c", " ", "\xa0", "\x1f",
         "日", "İ", "ß", "don't", "!!", "\r", "\x0b", "\x0c", "<|startoftext|>", "Word", "#$%", "&*", "a;", "né:?", "ÀÿÖ", "ẞ", "'ll", "12ab"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def check_places(rows, size):
    """Sequences are gapless from 0 and hold at most ``size``; returns their number."""
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= size
    return len(held)


def test_words_equal_whole_texts(library, monkeypatch):
    rng = random.Random(7)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(14))) for _ in range(4000)]
    for kept in (500_000, 5):
        monkeypatch.setattr(packing, "WORDS_KEPT", kept)
        got = list(packing.WordIds(FILE).encode([None, *texts, "x" * 9000]))
        assert got[0] == b""
        for t, ids in zip([*texts, "x" * 9000], got[1:], strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_knapsack_equals_trying_all():
    rng = np.random.default_rng(8)
    for _ in range(40):
        w = np.where(rng.random(25) < 0.4, rng.random(25), 0)
        w[0] = 0
        best = np.zeros(25)
        for c in range(1, 25):
            best[c] = max([best[c - 1], *(best[c - n] + w[n] for n in range(1, c + 1))])
        value, last = packing.best_values(w)
        assert np.allclose(value, best)
        found = packing.fill(24, last)
        assert sum(n * k for n, k in found.items()) <= 24
        assert np.isclose(sum(w[n] * k for n, k in found.items()), best[24])


@pytest.mark.parametrize("seed", range(6))
def test_plan_takes_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, (2, 50, 3000)[seed % 3], 65) * (rng.random(65) < 0.7)
    counts[0] = 0
    plan = packing.plan(counts)
    taken = np.zeros(65, int)
    for filling, n in plan:
        assert sum(m * k for m, k in filling) <= 64
        for m, k in filling:
            taken[m] += k * n
    assert (taken == counts).all()
    assert sum(n for _, n in plan) <= sum(n for _, n in packing.best_fit(counts))
    assert packing.plan(np.zeros(65, int)) == []


def test_edges(spark, library):
    rows = [(1, None, 0), (2, "", 0), (3, "word", 0), (3, "word", 0), (None, "one two", 0), (5, "a b " * 5000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = packing.pack(df, FILE).collect()
    assert sum(r.length for r in got) == 1 + 1 + 2 + 2 + 3 + 10_001
    assert check_places(got, 2048) == 5
    assert sorted((r.piece, r.start, r.length) for r in got if r.doc_id == 5) == [
        (i, 2048 * i, min(2048, 10_001 - 2048 * i)) for i in range(5)
    ]
    assert packing.pack(df.limit(0), FILE).collect() == []


def test_query_packs_everything(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op10_packing"](spark, SF).collect()
    want = {}
    for i, t in texts.items():
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        for p, at in enumerate(range(0, len(ids), 8192)):
            part = ids[at : at + 8192]
            want[i, p] = (at // 4, len(part) // 4, zlib.crc32(part))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    assert len(got) == len(want)
    assert check_places(got, 2048) <= -(-sum(x[1] for x in want.values()) // 2048) * 1.01 + 1

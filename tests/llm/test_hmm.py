import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from wardgate.llm import hmm
from wardgate.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def model(seed=0, states=3, symbols=5):
    rng = np.random.default_rng(seed)
    norm = lambda a, axis: a / a.sum(axis=axis, keepdims=True)
    return hmm.Model(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((symbols, states)), 0))


def paths(seq, m):
    """Probability of every path of states."""
    for p in itertools.product(range(len(m.start)), repeat=len(seq)):
        x = m.start[p[0]] * m.emits[seq[0], p[0]]
        for a, b, s in zip(p, p[1:], seq[1:], strict=False):
            x *= m.moves[a, b] * m.emits[s, b]
        yield p, x


SEQUENCES = [np.array(s, np.int32) for s in ([0], [1, 2, 3, 4], [4, 4], [0, 1, 0, 1, 0], [2], [3, 1, 2, 2, 0, 4])]


@pytest.mark.parametrize("bound", [1_000_000, 4])
def test_forward_equals_all_paths(bound, monkeypatch):
    monkeypatch.setattr(hmm, "TOKENS_AT_A_TIME", bound)
    m = model()
    want = [math.log10(sum(x for _, x in paths(s, m))) for s in SEQUENCES]
    assert np.allclose(hmm.log_likelihoods(SEQUENCES, m), want)


def test_expected_counts_equal_all_paths():
    m = model(1)
    starts, moves, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for s in SEQUENCES:
        all_ = list(paths(s, m))
        z = sum(x for _, x in all_)
        for p, x in all_:
            starts[p[0]] += x / z
            for a, b in zip(p, p[1:], strict=False):
                moves[a, b] += x / z
            for a, i in zip(p, s, strict=True):
                emits[i, a] += x / z
    for got, want in zip(hmm.expected_counts(SEQUENCES, m), (starts, moves, emits), strict=True):
        assert np.allclose(got, want, atol=1e-5)


def test_texts_of_one_word_sum_to_one(spark):
    """The shares of all words, one unseen word and the end of a symbol sequence are a distribution."""
    rows = [(i, t) for i, t in enumerate(["a b c a", "b d", "", None, "a\x0bE e"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counts = hmm.count_words(df, "text")
    lex = hmm.lexicon(counts, 5)
    words = Counter(w for _, t in rows for w in hmm.words_of(t))
    assert (lex.total, lex.distinct) == (sum(words.values()) + 5, len(words) + 1)
    assert np.isclose(lex.symbol_masses().sum(), lex.total + 0.1 * (len(words) + 1 + hmm.CLASSES))  # a place for unseen words per class


def plain(docs):
    train = [(i, t) for i, t in docs if zlib.crc32(str(i).encode()) % 10]
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + [None]
    c = Counter(w for _, t in train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    out = {}
    for i, t in docs:
        w = tokens(t)
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        out[i] = (zlib.crc32(str(i).encode()) % 10 == 0, len(w), sum(c[x] > 0 for x in w), n, base)
    return out


@pytest.mark.parametrize("small", [False, True])
def test_query(spark, small, monkeypatch):
    if small:  # most words beyond the lookup
        monkeypatch.setattr(hmm, "FREQUENT", 300)
        monkeypatch.setattr(hmm, "LOOKUP", 500)
        monkeypatch.setattr(hmm, "WORDS_HELD", 50)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = plain(docs)
    got = QUERIES["op5_language_model"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        held, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    unseen = [r for r in got if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
    print(sum(r.score for r in unseen) / sum(r.n_tokens for r in unseen), sum(r.base_score for r in unseen) / sum(r.n_tokens for r in unseen))


def test_edges(spark):
    rows = [(1, None, 1, "x"), (2, "", 2, "y"), (None, "a a", 3, "z"), (1, "a b", 4, "w"), (1, "a b", 4, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int, train string")
    got = hmm.score(df).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 3), (1, 1), (1, 3), (1, 3), (2, 1)]
    assert hmm.score(df.limit(0)).collect() == []
    nothing = hmm.score(df.where("doc_id = 2"), train_where=df["score"] > 9).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in nothing] == [(1, 0, 0, 0.0)]

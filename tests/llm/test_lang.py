import zlib

import numpy as np
import pytest

from wardgate.llm import lang
from wardgate.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
ROWS = [
    (1, "the cat and the dog", "en", 0),
    (2, "der Hund und die Katze", "de", 0),
    (3, "der Hund und die Katze", "de", 0),
    (4, None, "de", 0),
    (5, "", "en", 0),
    (6, "123 !!", "xx", 0),
    (7, "le chien et le chat", None, 0),
]
SCHEMA = "doc_id long, text string, lang string, lang_pred int"


def predict(spark, df, model):
    return {r.doc_id: (r.p.lang_pred, r.p.score) for r in df.select("doc_id", lang.predicted(df, "text", model).alias("p")).collect()}


def brute(texts):
    """Counts of hashed n-grams, one text and one n-gram at a time."""
    total = np.zeros(lang.BUCKETS, int)
    for t in texts:
        words = lang._words.findall(t.lower())
        if words:
            s = f" {' '.join(words)} "
            for n in lang.GRAMS:
                for i in range(len(s) - n + 1):
                    h = 0
                    for k, c in enumerate(s[i : i + n], 1):
                        h = (h * 0x9E3779B97F4A7C15 ^ (ord(c) + k)) % 2**64
                    h = h * 0xC2B2AE3D27D4EB4F % 2**64
                    h = (h ^ h >> 29) * 0x165667B19E3779F9 % 2**64 >> 48
                    total[h & (lang.BUCKETS - 1)] += 1
    return total


def test_matrix_equals_plain_counts(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    model = lang.fit(df)
    assert model.languages == ["de", "en"]
    assert np.allclose(np.exp(model.prior), [2 / 3, 1 / 3])
    for i, name in enumerate(model.languages):
        c = brute(r[1] for r in ROWS if r[2] == name and r[1])
        want = np.log((c + lang.SMOOTHING) / (c.sum() + lang.SMOOTHING * lang.BUCKETS))
        assert np.allclose(model.matrix[:, i], want)


def test_slices_count_each_gram_once(monkeypatch):
    texts = ["ab cde " * 50, None, "x", "é ü" * 9]
    whole = [b for b, _, _ in lang.sparse_grams(texts)]
    monkeypatch.setattr(lang, "SLICE", 7)
    cut = [b for b, _, _ in lang.sparse_grams(texts)]
    count = lambda x: np.bincount(np.concatenate(x), minlength=lang.BUCKETS)
    assert (count(whole) == count(cut)).all()
    assert (count(whole) == brute(t for t in texts if t)).all()


def test_edges(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = predict(spark, df, lang.fit(df))
    assert got[1][0] == "en" and got[2][0] == got[3][0] == "de"
    assert got[4] == got[5] == got[6] == ("und", 0.0)
    assert set(predict(spark, df, lang.fit(df.limit(0))).values()) == {("und", 0.0)}
    assert predict(spark, df.limit(0), lang.fit(df)) == {}


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op4_language"](spark, SF).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize("size", [1, 100_000])
def test_long_texts(size):
    model = lang.Model(["a"], np.zeros(1), np.zeros((lang.BUCKETS, 1)))
    assert lang.scored(["wort " * size], model)[0] == ["a"]

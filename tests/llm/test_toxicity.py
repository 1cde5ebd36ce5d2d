import numpy as np

from wardgate.llm import toxicity
from wardgate.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def test_features_by_hand():
    words = toxicity.Words(frozenset({"vequ*"}))
    f = toxicity.features("You are an IDIOT! a vequeur m0r0n fine", words)
    assert len(f) == toxicity.FEATURES
    assert np.isclose(f[1], 12.5) and np.isclose(f[2], 12.5) and np.isclose(f[3], np.log1p(3))
    assert np.isclose(f[5], 2 / 3) and np.isclose(f[11], 12.5) and f[12] == 3
    assert np.isclose(f[7], 6 / 28, atol=0.03)
    for t in (None, "", " \n"):
        assert toxicity.features(t, words) == [0.0] * toxicity.FEATURES
    assert np.isfinite(toxicity.features("w0rd " * 50_000, words)).all()


def rows(spark):
    docs = [(i, ("you zork " * 5 if i % 4 == 0 else "quiet text ") + f"number {i}", i, "s") for i in range(400)]
    docs += [(1000, None, 1, "s"), (1001, "", 1, "s"), (1001, "", 1, "s"), (None, "you zork", 1, "s")]
    labels = [(i, int(i % 4 == 0), 1) for i in range(300)] + [(5, 0, 1), (7777, 1, 1), (None, 1, 1), (8, None, 1)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, score int, prediction string"),
        spark.createDataFrame(labels, "doc_id long, toxic int, text int"),
    )


def test_learns_a_lexicon_and_scores(spark):
    docs, labels = rows(spark)
    model = toxicity.fit(docs, labels)
    assert "zork" in model.learned and "quiet" not in model.learned
    got = toxicity.score(docs, model)
    assert set(got.columns) == {"doc_id", "text", "prediction", "score", "predicted"}
    got = got.collect()
    assert len(got) == 404
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
        if r.doc_id is not None and r.doc_id < 400:
            assert r.predicted == (r.doc_id % 4 == 0)


def test_unlike_texts_all_count_and_copies_once(spark):
    # every text holds the common words; each of ten toxic terms is in ten texts, and one more in ten copies
    common = "the of and to in is that was for on"
    docs = [(i, f"{common} grobw{'abcdefghij'[i % 10]} nr {i}", 1) for i in range(100)]
    docs += [(100 + i, f"{common} Snorf  nr {' ' * i}", 1) for i in range(10)]
    docs += [(200 + i, f"{common} fine nr {i}", 0) for i in range(200)]
    table = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in docs], "doc_id long, toxic int")
    learned = toxicity.learned_lexicon(table, labels, "doc_id", "text")
    assert {f"grobw{c}" for c in "abcdefghij"} <= learned and "snorf" not in learned and "fine" not in learned


def test_one_class_and_empty_tables(spark):
    docs, labels = rows(spark)
    for some, value in ((labels.limit(0), 0.0), (labels.where("toxic = 1"), 1.0), (labels.where("toxic = 0"), 0.0)):
        assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, some)).collect()} == {value}
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, labels)).collect() == []
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs.limit(0), labels)).collect()} == {0.0}


def test_held_out_quality(spark):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = QUERIES["op1_toxicity"](spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    hit = sum(p and t for p, t in held)
    assert hit / sum(t for _, t in held) > 0.8  # some labelled texts hold nothing toxic, some stems are seen once
    assert hit / sum(p for p, _ in held) > 0.95

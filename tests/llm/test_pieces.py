import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from wardgate.llm.pieces import PieceCodec, piece_digests, piece_ids, pieces_text
from wardgate.llm.queries import QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LETTERS = "aab  ▁\n\té́ﬁＡ😀x.,;:!?'日本語ü²_\x00<s>01thernd "


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def mine():
    return PieceCodec(MODEL)


def test_random_texts(library, mine):
    rng = random.Random(3)
    for _ in range(4000):
        s = "".join(rng.choice(LETTERS) for _ in range(rng.randrange(0, 40)))
        ids = library.encode(s)
        assert mine.encode(s) == ids
        assert mine.decode(ids) == library.decode(ids)


def test_random_ids(library, mine):
    rng = random.Random(4)
    for _ in range(2000):
        some = [0, 1, 2, 3, 200, 201, 230, 259, 264, 28705, 13, rng.randrange(32000)]
        ids = [rng.choice(some) for _ in range(rng.randrange(0, 12))]
        assert mine.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("word", ["a" * 3000, "ab" * 5000, "日" * 2000, " " * 5000, "x\n" * 900])
def test_long_words(library, mine, word):
    assert mine.encode(word) == library.encode(word)


def test_small_caches_give_the_same(library, mine, monkeypatch):
    monkeypatch.setattr("wardgate.llm.pieces.WORDS_KEPT", 3)
    monkeypatch.setattr("wardgate.llm.pieces.PAIRS_KEPT", 3)
    fresh = PieceCodec(MODEL)
    for s in ("the quick brown fox the quick", "der und die, der und die"):
        assert fresh.encode(s) == library.encode(s)


def test_columns_nulls_and_empty_tables(spark, library):
    rows = [(1, None, 5), (2, "", 5), (2, "", 5), (3, " a  b", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = df.select("doc_id", piece_digests(F.col("text"), MODEL).alias("d")).select("doc_id", "d.*")
    nothing = hashlib.sha256(b"").hexdigest()
    found = sorted(map(tuple, got.collect()))
    assert found[:3] == [(1, 0, nothing, nothing), (2, 0, nothing, nothing), (2, 0, nothing, nothing)]
    assert found[3][1] == len(library.encode(" a  b"))
    ids = df.select("text", piece_ids(F.col("text"), MODEL).alias("ids"))
    back = ids.select("text", pieces_text(F.col("ids"), MODEL).alias("back"))
    assert all((r.text or "") == r.back for r in back.collect())
    assert df.limit(0).select(piece_digests(F.col("text"), MODEL)).collect() == []


def test_query_equals_library(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op3_sentencepiece"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()

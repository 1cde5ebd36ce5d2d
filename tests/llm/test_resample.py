import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardgate.llm import resample
from wardgate.llm.ordering import numbered
from wardgate.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def buckets(text, size, longest):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(g.encode()) % size for g in grams]


def brute(rows, target, size=10_000, longest=1, percent=10, least=20):
    """{position: (doc_id, n_features, weight, score)} and the drawn (doc_id, score) in order."""
    s, t = Counter(), Counter()
    own = [buckets(x, size, longest) for _, x in rows]
    for _, b in own:
        s.update(b)
    for x in target:
        t.update(buckets(x, size, longest)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (s_all + size) / ((s[k] + 1) * (t_all + size)))) for k in range(size)]
    out, drawable = [], []
    for (i, _), (n, b) in zip(rows, own, strict=True):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[k] for k in b)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(b), weight, score))
        if n >= least:
            drawable.append((-score, i is None, i or 0, len(b), weight))
    drawable.sort()
    return out, [(None if null else i, -score) for score, null, i, *_ in drawable[: percent * len(drawable) // 100]]


def check(df, want):
    rows = df.collect()
    every, drawn = want
    assert sorted((r[:4] for r in map(tuple, rows)), key=str) == sorted(every, key=str)
    ranked = sorted((r for r in rows if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r["doc_id"], r["score"]) for r in ranked] == drawn


def made(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, rank int, weight int")


def test_edges_against_brute_force(spark):
    rng = np.random.default_rng(1)
    vocabulary = ["Alpha", "beta", "GAMMA", "déjà", "ÉT", "x1", "数", "a-b", "c_d", "e\x7ff", "g\x85h"]
    rows = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(0, 60))))) for i in range(400)]
    rows += [(None, None), (7, ""), (8, "?!"), (None, rows[5][1]), (5, rows[5][1]), (5, rows[5][1]), (500, "long " * 50_000)]
    target = ["alpha beta", None, "", "déjà " * 9]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    check(resample.resample(made(spark, rows), goal), brute(rows, target))
    two = {"size": 97, "longest": 2, "percent": 35, "least": 3}
    got = resample.resample(made(spark, rows), goal, percent=35, least_words=3, buckets=97, longest=2)
    check(got, brute(rows, target, **two))
    check(resample.resample(made(spark, rows), goal.limit(0)), brute(rows, []))


def test_no_rows_and_nothing_to_draw(spark):
    goal = spark.createDataFrame([("a b",)], "text string")
    assert resample.resample(made(spark, []), goal).count() == 0
    few = [(i, "word " * 30) for i in range(9)]
    check(resample.resample(made(spark, few), goal), brute(few, ["a b"]))


@pytest.mark.parametrize("margin,accuracy", [(1e-6, 4), (0.002, 4000), (2.0, 100)])
def test_bracket_holds_the_cutoff_however_bad_the_sketch(spark, margin, accuracy):
    scores = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 500).otherwise(F.col("id") % 1000).alias("score"))
    ordered = sorted((r[0] for r in scores.collect()), reverse=True)
    for percent in (1, 10, 50, 99):
        low, high, above, k = resample.bracket(scores, percent, margin, accuracy)
        assert k == 200 * percent and low <= ordered[k - 1] <= high
        assert above == sum(s > high for s in ordered)


def test_numbered_rows(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v"), F.lit(1).alias("number"))
    got = numbered(df.drop("number"), [F.desc("v")], "test").collect()
    assert sorted(r["number"] for r in got) == list(range(1, 5001))
    assert [r["v"] for r in sorted(got, key=lambda r: r["number"])] == sorted((r["v"] for r in got), reverse=True)


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    goal = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    check(QUERIES["op13_resampling"](spark, SF), brute([tuple(r) for r in docs], goal))

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from wardgate.llm import exact

SCHEMA = "doc_id long, text string, keep_id string, range string"


def brute(rows):
    """Sorted (doc_id, keep_id, size, kept, digest), grouping whole normalised texts."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for norm, members in groups.items():
        members.sort()
        digest = hashlib.sha256(norm.encode()).hexdigest()
        out += [(m[3], members[0][3], len(members), k == 0, digest) for k, m in enumerate(members)]
    return sorted(out, key=str)


def found(df):
    cols = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "theirs", "theirs") for i, t in rows], SCHEMA)


def test_edges_against_brute_force(spark):
    rows = [
        (1, None), (2, ""), (3, " \t\n\x0b\f\r"), (4, "a b"), (5, "ab"), (6, "a  b"), (6, "a  b"), (None, "a  b"), (7, "ab "),
        (8, "ab\x85"), (9, "ab\x1c"), (10, "é"), (11, "é"), (12, "🙂 🙂"), (13, "🙂🙂"), (14, "x" * 300_000), (15, " " + "x" * 300_000),
        (16, "x" * 299_999 + "y"), (17, "A b"),
    ]
    assert found(exact.exact_duplicates(frame(spark, rows))) == brute(rows)


def test_one_group_over_all_ranges(spark, many_ranges):
    rng = np.random.default_rng(3)
    rows = [(i, "same text " + " " * int(rng.integers(4))) for i in range(700)]
    rows += [(1000 + i, f"same text {i // 2}") for i in range(200)] + [(2000 + i, "prefix " * 40 + str(i % 50)) for i in range(200)]
    rng.shuffle(rows)
    rows = [(int(i), t) for i, t in rows]
    df = exact.exact_duplicates(frame(spark, rows).repartition(5))
    assert found(df) == brute(rows)


def test_no_rows(spark):
    df = exact.exact_duplicates(frame(spark, []).select("text", "doc_id"))
    assert df.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and df.count() == 0


def test_runs_go_on_over_batches():
    texts = ["a", "a", "a", "b", "c", "c", "c", "c"]
    for cut in range(1, len(texts)):
        parts = [(0, cut), (cut, len(texts))]
        batches = [
            (pa.record_batch({"doc_id": list(range(x, y)), "text_sha256": texts[x:y]}), pa.array(texts[x:y], pa.string())) for x, y in parts
        ]
        rows = [r for t in exact.runs(iter(batches)) for r in t.to_pylist()]
        assert [r["keep_id"] for r in rows] == [0, 0, 0, 3, 4, 4, 4, 4]
        assert [r["group_size"] for r in rows] == [3, 3, 3, 1, 4, 4, 4, 4]
        assert [r["edge"] for r in rows] == ["a", None, None, None, None, None, None, "c"]

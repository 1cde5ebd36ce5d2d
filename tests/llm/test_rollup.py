import random

import duckdb

from wardgate.llm import rollup
from wardgate.llm.common import new_folder
from wardgate.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def totals(r):
    return {(x.source, x.lang, x.version): (x.n_docs, x.n_tokens) for x in r.totals().collect()}


def test_batches_equal_a_recount(spark):
    rng = random.Random(10)
    kept = rollup.TokenRollup(spark, new_folder(spark, "rollup-test"))
    state = {}
    for batch in range(4):
        rows = []
        for seq in range(30):
            op = rng.choice(["insert", "revise", "delete"])
            key = (rng.randrange(12), rng.choice(["v1", "v2"]))
            value = (rng.choice(["a", None]), rng.choice(["en", "de", None]), rng.choice([None, 3, 7]))
            rows.append((op, *key, *value, seq))
            if op == "delete":
                state.pop(key, None)
            else:
                state[key] = value
        rows += [("insert", None, "v1", "a", "en", 1, 99), ("insert", 1, None, "a", "en", 1, 99)]
        df = spark.createDataFrame(rows, rollup.CHANGES)
        assert kept.commit(f"b{batch}", df)
        assert not kept.commit(f"b{batch}", df)
        want = {}
        for (_, v), (s, g, n) in state.items():
            d, t = want.get((s, g, v), (0, 0))
            want[s, g, v] = (d + 1, t + (n or 0))
        assert totals(kept) == want


def test_a_batch_that_broke_off_counts_once(spark):
    folder = new_folder(spark, "rollup-test")
    kept = rollup.TokenRollup(spark, folder)
    df = spark.createDataFrame([("insert", 1, "v", "s", "en", 5, 0)], rollup.CHANGES)
    df.limit(0).select("doc_id").write.parquet(f"{folder}/ledger/b")  # the first folder only
    assert totals(kept) == {}
    assert kept.commit("b", df) and not kept.commit("b", df)
    assert totals(kept) == {("s", "en", "v"): (1, 5)}


def test_empty(spark):
    kept = rollup.TokenRollup(spark, new_folder(spark, "rollup-test"))
    assert totals(kept) == {}
    kept.commit("none", spark.createDataFrame([], rollup.CHANGES))
    assert totals(kept) == {}


def test_query_equals_twin(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(con.execute(ORACLES["op8_token_counts"]).fetchall())
    got = sorted((r.source, r.lang, r.version, r.n_docs, r.n_tokens) for r in QUERIES["op8_token_counts"](spark, SF).collect())
    assert got == want

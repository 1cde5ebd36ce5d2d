"""What the physical plans must look like."""

import re

from pyspark.sql import functions as F

import __spark_entry__ as se
from wardgate.operators import sampling
from wardgate.operators import tables as tb
from wardgate.operators.dispositions import apply_gate
from wardgate.plans.fixtures import fixture
from wardgate.plans.registry import AS_OF

SF_DIR = "/root/testdata/sf0.001"
def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_gate_tests_each_pattern_once(spark):
    text = apply_gate(fixture(spark, SF_DIR, "intake"))._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("RLIKE(") + text.count(" RLIKE ") == 2
    assert text.count("lower(clinical_payload") == 1


def test_only_used_columns_are_read(spark):
    text = plan(se.queries()["A8_compliance_stats"](spark, SF_DIR))
    # the columns that id, consent and notice date are derived from, and no other
    read = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1).split(",")
    assert {x.partition(":")[0] for x in read} == {"o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"}


def test_scenario_marks_sort_no_input_rows(spark):
    """The draws are counted by prefix; the marking itself is a projection without window or shuffle."""
    text = plan(sampling.mark_scenarios(fixture(spark, SF_DIR, "intake"), AS_OF))
    assert "Window" not in text and "Exchange" not in text


def test_rank_filter_runs_before_the_shuffle(spark):
    df = fixture(spark, SF_DIR, "batch2")
    for out in (tb.keep_last(df, "notice_id", "arrival_seq"), se.queries()["W3_top_items"](spark, SF_DIR)):
        text = plan(out)
        ranked = text[text.index("Final") :]  # top down: final rank, shuffle, partial rank
        assert ranked.index("Exchange") < ranked.index("Partial")


def test_hot_key_reaches_the_reducer_as_one_row_per_task(spark):
    """A third of all rows share one key: the shuffle carries at most one of them per map task."""
    n = 30000
    df = spark.range(0, n, 1, 6).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"),
        F.col("id").alias("seq"),
    )
    out = tb.keep_last(df, "k", "seq")
    assert out.count() == n - n // 3 + 1
    assert out.filter("k = 'hot'").first()["seq"] == n - 3

import pytest
from pyspark.sql import functions as F

from wardgate.operators import metrics


def rows(df):
    return sorted((r["category"], r["rank"], r["item"], r["n"]) for r in df.collect())


@pytest.mark.parametrize("tracked,named", [(10_000, 1_000), (64, 8), (8, 6)])
def test_bounded_top_items_are_exact(spark, tracked, named):
    """Heavy items among many rare ones, a category of rare ones alone, and one of few items."""
    n = F.col("id")
    rare = F.concat(F.lit("rare "), n)
    heavy = spark.range(6000).select(F.lit("mixed").alias("category"), F.when(n % 3 == 0, F.concat(F.lit("h"), n % 7)).otherwise(rare).alias("item"))
    flat = spark.range(3000).select(F.lit("flat").alias("category"), F.concat(F.lit("f"), n % 1500).alias("item"))
    few = spark.range(40).select(F.lit("few").alias("category"), F.concat(F.lit("g"), n % 3).alias("item"))
    items = heavy.union(flat).union(few).repartition(7)
    want = metrics.top_items(items.groupBy("category", "item").agg(F.count("*").alias("n")))
    assert rows(metrics.bounded_top_items(items, tracked=tracked, named=named)) == rows(want)
    assert metrics.bounded_top_items(items.limit(0)).collect() == []

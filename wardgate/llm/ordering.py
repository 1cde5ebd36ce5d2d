"""Tables in one order over many tasks: sorted ranges, and row numbers that no single task counts."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardgate.llm.common import landed

ROW_BITS = 33  # of monotonically_increasing_id: the row within its partition


def numbered(df: DataFrame, order: list[Column], label: str, number: str = "number") -> DataFrame:
    """``df`` with its place (from 1) in ``order``.

    Sampled splitters cut the order into ranges, each range is sorted by a task of its own, and the landed rows get the count of
    the ranges before theirs.  The driver sees one count a range.  Rows that ``order`` does not tell apart are
    numbered in any order.
    """
    row = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = landed(
        ranged.withColumn("__range", F.shiftright(row, ROW_BITS)).withColumn("__row", row.bitwiseAND((1 << ROW_BITS) - 1)),
        label,
    )
    counts = sorted((r["__range"], r["n"]) for r in placed.groupBy("__range").agg(F.count("*").alias("n")).collect())
    before = accumulate((n for _, n in counts), initial=0)
    starts = df.sparkSession.createDataFrame(
        [(part, start) for (part, _), start in zip(counts, before, strict=False)], "__range long, __start long"
    )
    # one row a range
    joined = placed.join(F.broadcast(starts), "__range")
    return joined.withColumn(number, F.col("__start") + F.col("__row") + 1).select(*df.columns, number)

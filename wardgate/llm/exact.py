"""Exact duplicates by sorting the texts' contents.

A text is normalised by deleting white space.  Rows are put in one order: the leading characters of the normalised text, its digest,
the rest of it, then the longer original first, then the id.  Spark samples splitters of that order (they hold
the leading characters and the digest, never whole texts), moves each range to a task and sorts it there, on
disk where it must.  Equal texts become neighbours; each row is compared in full with the one before, and a new run begins
where they differ.  A run's first row is the one that stays.

The id is part of the order, so a text with very many copies is cut into several ranges like any other rows.  Runs that go
on in the next range are joined afterwards: the last text of each range is compared in full with the first of the
next, and one flag a range reaches the driver.

Null counts as empty; empty and blank texts are one group.  Of equal lengths the smallest id stays, null ids come last.  Rows
repeated with one id are one group like all equal texts, and exactly one row of a group is kept.  An empty table gives no
rows.  A task holds a batch of texts, and the ids of one run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardgate.llm.common import landed

LEADING = 64
BLANK = r"[\x20\x09-\x0D]+"


def normal(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, "")


def _whole_runs(rows: pa.Table, of: np.ndarray) -> pa.Table:
    """``rows`` of runs ``of`` with the id and size of their run, and whether each is its head."""
    heads, inverse, size = np.unique(of, return_index=True, return_inverse=True, return_counts=True)[1:]
    head = np.zeros(len(of), bool)
    head[heads] = True
    out = rows.append_column("keep_id", rows["doc_id"].take(pa.array(heads[inverse])))
    for name, values in (("group_size", size[inverse]), ("head", head), ("run", of)):
        out = out.append_column(name, pa.array(values))
    return out


def runs(batches: Iterator[tuple[pa.RecordBatch, pa.Array]]) -> Iterator[pa.Table]:
    """Rows of sorted (rows, texts) batches by runs of equal texts; ``edge`` holds the first and the last text of all."""
    run, before, open_, numbers = -1, None, [], []

    def table(rows: pa.Table, of: np.ndarray, first: str | None, last: str | None) -> pa.Table:
        edge = [None] * len(of)
        edge[-1] = last
        if first is not None:
            edge[0] = first
        return _whole_runs(rows, of).append_column("edge", pa.array(edge, pa.string()))

    first = None
    for rows, texts in batches:
        if not len(texts):
            continue
        top = texts[0].as_py()
        first = top if before is None and run < 0 else first
        new = np.ones(len(texts), bool)
        new[0] = run < 0 or top != before
        new[1:] = pc.not_equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False)
        of = run + np.cumsum(new)
        run, before = int(of[-1]), texts[-1].as_py()
        open_.append(pa.Table.from_batches([rows]))
        numbers.append(of)
        if numbers[0][0] < run:  # some runs have ended
            held, of = pa.concat_tables(open_), np.concatenate(numbers)
            ended = int(np.searchsorted(of, run))
            yield table(held.slice(0, ended), of[:ended], first, None)
            open_, numbers, first = [held.slice(ended)], [of[ended:]], None
    if open_:
        yield table(pa.concat_tables(open_), np.concatenate(numbers), first, before)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for t in runs((b.select(["doc_id", "text_sha256"]), b["normal"]) for b in batches):
        t = t.append_column("range", pa.array(np.full(len(t), part, np.int64)))
        yield from t.combine_chunks().to_batches()


def _joined(marked: DataFrame) -> list[tuple]:
    """(range, run, id that stays, size, whether it is the group's first run) of the runs that go on in other ranges."""
    edges = marked.where("edge IS NOT NULL")
    of_run = F.struct("run", "keep_id", "group_size")
    ends = edges.groupBy("range").agg(
        F.min_by("edge", "run").alias("first"),
        F.max_by("edge", "run").alias("last"),
        F.min_by(of_run, "run").alias("first_run"),
        F.max_by(of_run, "run").alias("last_run"),
    )
    ends = landed(ends, "range-ends")  # one row a range
    of = {r["range"]: r for r in ends.select("range", "first_run", "last_run").collect()}
    order = sorted(of)
    if len(order) < 2:
        return []
    pairs = marked.sparkSession.createDataFrame(list(zip(order, order[1:], strict=False)), "range long, next long")
    after = ends.select(F.col("range").alias("next"), "first")
    go_on = {
        r["range"]
        for r in pairs.join(ends.select("range", "last"), "range").join(after, "next").where("last = first").select("range").collect()
    }
    chains: list[list[tuple[int, object]]] = []
    for part, after_part in zip(order, order[1:], strict=False):
        if part not in go_on:
            continue
        tail, head = (part, of[part]["last_run"]), (after_part, of[after_part]["first_run"])
        if chains and chains[-1][-1][0] == part and chains[-1][-1][1]["run"] == tail[1]["run"]:
            chains[-1].append(head)
        else:
            chains.append([tail, head])
    return [
        (part, r["run"], chain[0][1]["keep_id"], sum(x["group_size"] for _, x in chain), k == 0)
        for chain in chains
        for k, (part, r) in enumerate(chain)
    ]


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    id_type = docs.schema[doc_id].dataType
    texts = docs.select(
        F.col(doc_id).alias("doc_id"),
        normal(F.col(text)).alias("normal"),
        F.coalesce(F.length(text), F.lit(0)).alias("n_points"),
    ).withColumn("text_sha256", F.sha2("normal", 256))
    first = [F.substring("normal", 1, LEADING), F.col("text_sha256")]
    last = [F.desc("n_points"), F.asc_nulls_last("doc_id")]
    ranged = texts.repartitionByRange(*first, *last).sortWithinPartitions(*first, "normal", *last)
    schema = T.StructType(
        [
            T.StructField("doc_id", id_type),
            T.StructField("text_sha256", T.StringType()),
            T.StructField("keep_id", id_type),
            T.StructField("group_size", T.LongType()),
            T.StructField("head", T.BooleanType()),
            T.StructField("run", T.LongType()),
            T.StructField("edge", T.StringType()),
            T.StructField("range", T.LongType()),
        ]
    )
    marked = landed(ranged.select("doc_id", "text_sha256", "normal").mapInArrow(_marked, schema), "runs")
    joined = _joined(marked)
    rows = marked.drop("edge")
    if joined:
        fields = "range long, run long, keep_id {}, group_size long, leads boolean".format(id_type.simpleString())
        whole = docs.sparkSession.createDataFrame(joined, fields).select("range", "run", F.struct("keep_id", "group_size", "leads").alias("all"))
        rows = rows.join(F.broadcast(whole), ["range", "run"], "left")  # at most two rows a range
    else:
        rows = rows.withColumn("all", F.lit(None).cast(f"struct<keep_id: {id_type.simpleString()}, group_size: bigint, leads: boolean>"))
    alone = F.col("all").isNull()
    return rows.select(
        "doc_id",
        F.when(alone, F.col("keep_id")).otherwise(F.col("all.keep_id")).alias("keep_id"),
        F.when(alone, F.col("group_size")).otherwise(F.col("all.group_size")).alias("group_size"),
        (F.col("head") & (alone | F.col("all.leads"))).alias("kept"),
        "text_sha256",
    )

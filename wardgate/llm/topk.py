"""Exact top-k inner products by block-at-a-time pruning.

Vectors become integers, floor(1024 x) per component.  The rows are cut into ranges of ``BLOCK`` rows, and
``SEGMENT`` ranges form a segment, the unit of a task.  A range keeps the greatest and the smallest value of each
component; a query's sum over its terms of the larger product is a bound on every score in the range.  Queries
visit ranges by falling bound, score them through their forward index (the integers of the range), and stop when
the bound falls below the kth score so far.

First every query visits the segment with the best bound for it; its kth score there is a floor.  Then it
visits the other segments whose bound reaches the floor.  Within a segment, rows are in the order of a hash of their direction, so that
near vectors share ranges; queries travel in blocks to segments, never rows to queries.

Vectors that are null, empty, of another length than most, or hold null or non-finite components take no part,
nor do rows without an id.  Ties go to the smaller id; of repeated rows of one id each is a candidate.  Empty
tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardgate.llm.common import landed

SCALE = 1024.0
BLOCK = 128
SEGMENT_ROWS = 16_384
QUERY_ROWS = 4_096  # queries that visit a segment together
BOUNDS_AT_A_TIME = 1_024  # segments
PLANES = 12
TOP = 10


def usable(table: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v array<long>) of the vectors that take part."""
    x = F.transform(F.col(vector), lambda e: e.cast("double"))
    finite = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = table.select(F.col(vec_id).alias("vec_id"), x.alias("x")).where("vec_id is not null and size(x) > 0")
    return rows.where(finite).select(
        "vec_id", F.transform("x", lambda e: F.floor(e * F.lit(SCALE)).cast("long")).alias("v")
    )


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, np.int64) for v in vectors], np.int64)


def _signature(v: np.ndarray, dim: int) -> np.ndarray:
    """Signs against fixed random planes: rows in this order have near directions."""
    planes = np.random.default_rng(7).standard_normal((dim, PLANES))
    return ((v @ planes) > 0) @ (1 << np.arange(PLANES))


class Ranges:
    """Block ranges of a segment with their bounds and forward index."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        if len(v) and float(np.abs(v).max()) ** 2 * v.shape[1] < 2.0**53 / 4:
            v = v.astype(float)  # exact as long as every sum is an integer below 2^53, and much faster
        order = np.lexsort((ids, _signature(v.astype(float), v.shape[1])))
        self.ids, self.v = ids[order], v[order]
        firsts = np.arange(0, len(ids), BLOCK)
        self.firsts = np.append(firsts, len(ids))
        self.high = np.maximum.reduceat(self.v, firsts, axis=0)
        self.low = np.minimum.reduceat(self.v, firsts, axis=0)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Queries x ranges: no row of the range scores more."""
        q = q.astype(self.v.dtype)
        return np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T

    def search(self, ids: np.ndarray, q: np.ndarray, floors: np.ndarray, k: int) -> Iterator[tuple]:
        """For each query the rows of this segment that may be among the k best."""
        bounds = self.bounds(q)
        q = q.astype(self.v.dtype)
        order = np.argsort(-bounds, axis=1, kind="stable")
        for i in range(len(q)):
            best_ids, best, kth = np.zeros(0, np.int64), np.zeros(0, np.int64), floors[i]
            for b in order[i]:
                if bounds[i, b] < kth:
                    break
                a, z = self.firsts[b], self.firsts[b + 1]
                scores = (self.v[a:z] @ q[i]).astype(np.int64)
                fit = (scores >= kth) & (self.ids[a:z] != ids[i])
                if not fit.any():
                    continue
                best_ids = np.concatenate([best_ids, self.ids[a:z][fit]])
                best = np.concatenate([best, scores[fit]])
                if len(best) > k:
                    keep = np.lexsort((best_ids, -best))[:k]
                    best_ids, best = best_ids[keep], best[keep]
                if len(best) == k:
                    kth = max(kth, best.min())
            if len(best):
                yield ids[i], best_ids, best


def search(
    table: DataFrame, queries: Column, k: int = TOP, vec_id: str = "vec_id", vector: str = "embedding",
    segment_rows: int = SEGMENT_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of ``table`` with the greatest integer inner product.

    ``queries`` is a condition on ``table``; a query's own row (any row of its id) is no candidate of it.
    """
    spark = table.sparkSession
    rows = landed(usable(table, vec_id, vector).withColumn("row", F.monotonically_increasing_id()), "vectors")
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = rows.where(F.size("v") == common["d"])
    n_segments = -(-common["count"] // segment_rows)
    placed = landed(
        rows.select("vec_id", "v", F.pmod(F.xxhash64("row"), F.lit(n_segments)).cast("int").alias("segment")), "segments"
    )
    asked = rows.join(table.where(queries).select(F.col(vec_id).alias("vec_id")).distinct(), "vec_id", "left_semi")
    asked = landed(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).distinct(), "queries")
    n_blocks = max(1, -(-asked.count() // query_rows))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int"))
    edges = landed(_edges(placed), "bounds")
    n_groups = -(-n_segments // BOUNDS_AT_A_TIME)

    def bounded(floored: DataFrame, best_only: bool) -> DataFrame:
        """(query_id, segment, bound): the best segment of each group, or all whose bound reaches the floor.

        Every query meets every segment's bounds, not its rows: blocks of queries by groups of bounds.
        """

        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            none = pd.DataFrame({"query_id": [], "segment": [], "bound": []}, dtype="int64")
            if not len(left) or not len(right):
                return none
            q, high, low = _matrix(left["q"]), _matrix(right["hi"]), _matrix(right["lo"])
            bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
            segments = right["segment"].to_numpy()
            if best_only:
                i, j = np.arange(len(q)), bounds.argmax(axis=1)
            else:
                i, j = np.nonzero(bounds >= left["floor"].to_numpy(np.int64)[:, None])
            return pd.DataFrame({"query_id": left["query_id"].to_numpy()[i], "segment": segments[j], "bound": bounds[i, j]})

        group = F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)))
        block = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
        to_bounds = edges.withColumn("group", F.expr(f"cast(segment div {BOUNDS_AT_A_TIME} as int)")).withColumn("block", block)
        return (
            floored.withColumn("group", group)
            .groupBy("block", "group")
            .cogroup(to_bounds.groupBy("block", "group"))
            .applyInPandas(run, "query_id long, segment int, bound long")
        )

    def visit(pairs: DataFrame, floored: DataFrame) -> DataFrame:
        """(query_id, vec_id, score) from the segments in ``pairs`` (query_id, segment)."""

        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(left) and len(right):
                ranges = Ranges(left["vec_id"].to_numpy(np.int64), _matrix(left["v"]))
                ids, floors = right["query_id"].to_numpy(np.int64), right["floor"].to_numpy(np.int64)
                out = list(ranges.search(ids, _matrix(right["q"]), floors, k))
            if not out:
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
            return pd.DataFrame(
                {
                    "query_id": np.repeat([q for q, _, _ in out], [len(i) for _, i, _ in out]),
                    "vec_id": np.concatenate([i for _, i, _ in out]),
                    "score": np.concatenate([x for _, _, x in out]),
                }
            )

        to = pairs.join(floored, "query_id")
        wanted = to.select(F.col("segment").alias("part"), F.col("block").alias("of_block")).distinct()
        return (
            placed.join(wanted, F.col("segment") == F.col("part"))
            .groupBy("part", "of_block")
            .cogroup(to.groupBy("segment", "block"))
            .applyInPandas(run, "query_id long, vec_id long, score long")
        )

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    lowest = F.lit(np.iinfo(np.int64).min)
    unfloored = asked.withColumn("floor", lowest)
    first = landed(
        bounded(unfloored, True).groupBy("query_id").agg(F.max_by("segment", F.struct("bound", "segment")).alias("segment")),
        "first",
    )
    near = landed(visit(first, unfloored), "near")
    floors = near.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select("query_id", F.col("score").alias("floor"))
    floored = landed(asked.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", lowest)), "floors")
    rest = landed(bounded(floored, False).join(first, ["query_id", "segment"], "left_anti"), "rest")
    return (
        near.union(visit(rest, floored))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _edges(placed: DataFrame) -> DataFrame:
    """(segment, hi, lo): the greatest and smallest value of each component in each segment."""

    def summary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v, s = _matrix(b["v"]), b["segment"].to_numpy()
            order = np.argsort(s, kind="stable")
            s, v = s[order], v[order]
            at = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else []
            if len(at):
                hi, lo = np.maximum.reduceat(v, at, axis=0), np.minimum.reduceat(v, at, axis=0)
                d = np.tile(np.arange(v.shape[1]), len(at))
                yield pd.DataFrame({"segment": np.repeat(s[at], v.shape[1]), "d": d, "hi": hi.ravel(), "lo": lo.ravel()})

    return (
        placed.select("segment", "v")
        .mapInPandas(summary, "segment int, d int, hi long, lo long")
        .groupBy("segment", "d")
        .agg(F.max("hi").alias("hi"), F.min("lo").alias("lo"))
        .groupBy("segment")
        .agg(F.sort_array(F.collect_list(F.struct("d", "hi", "lo"))).alias("e"))
        .select("segment", F.col("e.hi").alias("hi"), F.col("e.lo").alias("lo"))
    )

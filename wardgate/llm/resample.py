"""Importance resampling towards a target distribution.

Words are runs of ASCII letters (A-Z in lower case), ASCII digits and all characters beyond ASCII; a feature is a run of up to
``longest`` words, and its bucket the crc32 of its bytes.  The bucket counts of all rows and of all target texts give
each bucket a gain, the floored log ratio of its smoothed shares in thousandths.  The gains are one array, and a row weighs
the sum over its buckets.  To the weight comes Gumbel noise from a digest of the id, so that the highest scores are
a draw without replacement in proportion to the weights.

The rows to draw are found without sorting all: a mergeable quantile sketch of the scores gives a bracket around the cutoff; the
rows above and inside it are counted exactly, and the bracket is widened until the counts show that it holds the
cutoff; the rows of the bracket alone are sorted to find it.  The drawn rows are then numbered over ranges.

Null and empty texts have no features and weigh nothing; they are not drawn while ``least_words`` is above zero.  A null id
has the noise of an empty one and comes last among ties.  Repeated rows count, and are drawn, as often as they occur.  Without target
texts all gains follow the source counts alone.  An empty table gives no rows.  Memory does not grow with
the length of a text beyond the text and its words.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardgate.llm.common import landed
from wardgate.llm.ordering import numbered

BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
KEPT = 400_000  # features a task remembers the bucket of
TEXTS_AT_A_TIME = 256
MARGIN, ACCURACY = 0.002, 4000  # half the first bracket, in quantiles; of the sketch

_KEPT_BYTES = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(0x80, 0x100))
_LOWER = bytes(range(256)).lower()
_WORD_BYTES = bytes(_LOWER[c] if _LOWER[c] in _KEPT_BYTES else 0x20 for c in range(256))


class _Buckets(dict):
    """Bucket of a feature, remembered; the memory is dropped as a whole when it is full."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.n
        return found


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD_BYTES).split() if text else []


def features(found: list[bytes], longest: int) -> list[bytes]:
    """All runs of up to ``longest`` words, joined by a space."""
    out = found
    for n in range(2, longest + 1):
        out = out + [b" ".join(found[i : i + n]) for i in range(len(found) - n + 1)]
    return out


def bucket_counts(texts: DataFrame, text: str, buckets: int, longest: int) -> np.ndarray:
    """Features of all texts by bucket: each task sums its own array, Spark the arrays."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, total = _Buckets(buckets), np.zeros(buckets, np.int64)
        for b in batches:
            for t in b["text"]:
                total += np.bincount([bucket[f] for f in features(words(t), longest)], minlength=buckets).astype(np.int64) if t else 0
        some = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": some.astype("int32"), "n": total[some]})

    parts = texts.select(F.col(text).cast("binary").alias("text")).mapInPandas(count, "bucket int, n long")
    sums = parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most one row a bucket
    out = np.zeros(buckets, np.int64)
    for r in sums:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares, rounded down."""
    buckets, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log(((t + 1) * (s_all + buckets)) / ((s + 1) * (t_all + buckets))))
            for s, t in zip(source.tolist(), target.tolist(), strict=True)
        ],
        np.int64,
    )


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variate from the first 32 bits of a digest of seed and id, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def weighed(docs: DataFrame, gain: np.ndarray, text: str, longest: int) -> Column:
    """Struct of ``n_words``, ``n_features`` and ``weight`` of each text."""
    size = len(gain)

    @F.pandas_udf("n_words long, n_features long, weight long")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bucket = _Buckets(size)
        for b in batches:
            rows = []
            for t in b:
                found = words(t)
                every = features(found, longest)
                at = [bucket[f] for f in every]
                rows.append((len(found), len(every), int(gain[at].sum()) if at else 0))
            yield pd.DataFrame(rows, columns=["n_words", "n_features", "weight"], dtype="int64")

    return weigh(F.col(text).cast("binary"))


def bracket(scores: DataFrame, percent: int, margin: float = MARGIN, accuracy: int = ACCURACY) -> tuple[int, int, int, int] | None:
    """(lowest, highest, rows above, rows to draw): scores between which the last row to draw lies; None without one.

    The sketch proposes, exact counts decide: too few or too many rows above widen the bracket fourfold, in the end to all.
    """
    q = 1 - percent / 100
    while True:
        ends = F.percentile_approx("score", [max(0.0, q - margin), min(1.0, q + margin)], F.lit(accuracy))
        n, found = scores.agg(F.count("*").alias("n"), ends.alias("ends")).first()
        k = percent * n // 100
        if not k:
            return None
        low, high = found
        if margin >= 1:  # everything
            low, high = scores.agg(F.min("score"), F.max("score")).first()
        above, inside = scores.agg(
            F.count_if(F.col("score") > high), F.count_if(F.col("score").between(low, high))
        ).first()
        if above < k <= above + inside:
            return low, high, above, k
        margin *= 4


def resample(
    docs: DataFrame,
    target: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    longest: int = 1,
    seed: int = SEED,
    **how,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row; rank numbers the drawn rows, best first, else null."""
    gain = gains(bucket_counts(docs, text, buckets, longest), bucket_counts(target, target_text, buckets, longest))
    narrow = docs.select(F.col(doc_id).alias("doc_id"), weighed(docs, gain, text, longest).alias("w"))
    rows = landed(
        narrow.select("doc_id", "w.*").withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "weights"
    )
    columns = ["doc_id", "n_features", "weight", "score"]
    undrawn = F.lit(None).cast("long").alias("rank")
    enough = F.col("n_words") >= least_words
    found = bracket(rows.where(enough), percent, **how)
    if found is None:
        return rows.select(*columns, undrawn)
    low, high, above, k = found
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    inside = numbered(rows.where(enough & F.col("score").between(low, high)), order, "bracket", "rank")
    over = numbered(rows.where(enough & (F.col("score") > high)), order, "over", "rank")
    place = F.col("rank") + above
    return (
        over.select(*columns, "rank")
        .union(inside.select(*columns, F.when(place <= k, place).alias("rank")))
        .union(rows.where(~enough | (F.col("score") < low)).select(*columns, undrawn))
    )

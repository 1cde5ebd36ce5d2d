"""Stages of the corpus pipeline: documents in, the documents that stay out, with the same columns.

Each stage fits what it needs on the documents it is given.  Other columns pass through untouched.  Empty inputs
give empty outputs; null texts are rejected by the language stage.
"""

from __future__ import annotations

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardgate.llm import lang, packing, simhash, substrings, toxicity
from wardgate.llm.common import landed, table

LEAST_SCORE = 0.5
LEAST_LIKENESS = -3.0  # nats an n-gram below what is usual in the language; texts in it lie above -2.5, random letters below -3.5
PASSAGE_WORDS = 51  # a repeated passage of so many words goes
PASSAGE_BYTES = 200  # and is looked for from this length on


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined, with a probability of at least ``LEAST_SCORE`` among the learned ones and a likeness
    of at least ``LEAST_LIKENESS``, so that letters of no learned language go (what labelled texts are full of is learned)."""
    model = lang.fit(docs)
    marked = docs.withColumn("__lang", lang.predicted(docs, "text", model, likeness=True))
    like = F.col("__lang.likeness") >= LEAST_LIKENESS
    kept = (F.col("__lang.lang_pred") != lang.UNDETERMINED) & (F.col("__lang.score") >= LEAST_SCORE) & like
    return marked.where(kept).select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic by a model of the labelled ones."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels)
    marked = docs.withColumn("__f", toxicity.featured(docs, "text", model.learned))
    row = F.struct(*docs.columns).alias("__row")
    return toxicity.scored(marked.select(row, "__f"), model, "__f").where("predicted = 0").select("__row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate component, once.

    Links are those of the operator: fingerprints of three-word shingles that differ in at most two bits.
    """
    groups = simhash.near_duplicates(docs)
    firsts = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id")).distinct()
    firsts = landed(firsts, "kept-ids")
    kept = docs.join(firsts, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"])


def whole_words(data: bytes, start: int, end: int) -> int:
    """Words between two bytes of a text; a word cut by either end does not count."""
    part = data[start:end].decode(errors="ignore")
    before = data[max(0, start - 4) : start].decode(errors="ignore")[-1:]
    after = data[end : end + 4].decode(errors="ignore")[:1]
    cut = (before.isalnum() and part[:1].isalnum()) + (after.isalnum() and part[-1:].isalnum())
    return len(part.split()) - cut


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the passages that it shares: runs covered by repeated strings of ``PASSAGE_BYTES`` bytes, where they
    have ``substrings.MIN_BYTES`` bytes or ``PASSAGE_WORDS`` whole words.  Characters cut in part go as a whole."""

    def long_enough(data: bytes, cuts) -> list:
        return [
            (a, b) for a, b in cuts if b - a >= substrings.MIN_BYTES or whole_words(data, a, b) >= PASSAGE_WORDS
        ]

    def without(data: bytes, cuts) -> str:
        return substrings.kept_bytes(data, long_enough(data, cuts)).decode(errors="ignore")

    @F.pandas_udf("string")
    def left(text: pd.Series, cut: pd.Series) -> pd.Series:
        parts = [
            t if c is None or t is None else without(t.encode(), c)
            for t, c in zip(text, cut, strict=True)
        ]
        return pd.Series(parts, dtype=object)

    rows = docs.withColumn("__row", F.struct(*docs.columns)).select("doc_id", "text", "__row")
    marked = substrings.removed(rows, min_bytes=PASSAGE_BYTES)
    changed = marked.withColumn("__text", left("text", "cut"))
    others = [F.col("__row")[c].alias(c) for c in docs.columns if c not in ("text", "n_chars")]
    out = changed.select(*others, F.col("__text").alias("text"), F.length("__text").cast("long").alias("n_chars"))
    return out.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in training sequences.

    Tasks remember fewer words than by default, for they share their executors with what earlier stages left.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), words_kept=150_000)

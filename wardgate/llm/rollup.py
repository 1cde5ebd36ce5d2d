"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are never recounted: each batch of inserts, deletes and revised
counts is turned into signed differences against what the ledger holds for its documents, and only the sums of
these are added.  A batch is two folders named after it, first the ledger rows of the keys it sets, then
its differences; it is committed once the second one is complete.  A batch that is committed already does nothing,
one that broke off is written anew, so every batch counts once whatever is lost or repeated.

A key is a document and a tokenizer version.  Within a batch the change with the greatest ``seq`` wins.  Inserting
a known key revises it, also its source and language; deleting an unknown one does nothing.  Rows without an id
or a version are left out; null sources and languages are groups of their own; a null count is zero.
One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHANGES = "op string, doc_id long, version string, source string, lang string, n_tokens long, seq long"
KEY = ["doc_id", "version"]
BY = ["source", "lang", "version"]
LEDGER = "doc_id long, version string, source string, lang string, n_tokens long, gone boolean, turn long"
DELTAS = "source string, lang string, version string, docs long, tokens long"

WORDS = "[^\\x20\\x09-\\x0D]+"
LETTER_WORDS = "[^\\x20\\x09-\\x0D]*\\p{L}[^\\x20\\x09-\\x0D]*"
MARKS = "\\p{L}+|\\p{N}+|[^\\p{L}\\p{N}\\x20\\x09-\\x0D]"


def matches(text: Column, pattern: str) -> Column:
    """Number of tokens a pattern finds (null text: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


class TokenRollup:
    """Totals kept in a shared folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _batches(self, part: str) -> list[str]:
        """Names of the batches whose folder in ``part`` is complete, in alphabetical order."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(f"{self.folder}/{part}")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(n for n in names if fs.exists(hadoop.Path(f"{self.folder}/{part}/{n}/_SUCCESS")))

    def _read(self, part: str, schema: str, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{part}/{n}" for n in names])

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply ``changes`` (columns of ``CHANGES``; op is insert, revise or delete) once; False if it was already."""
        done = self._batches("deltas")
        if batch in done:
            return False
        ledger = f"{self.folder}/ledger/{batch}"
        last = (
            changes.where("doc_id is not null and version is not null")
            .groupBy(*KEY)
            .agg(F.max(F.struct("seq", "op", "source", "lang", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))).alias("c"))
        )
        last.select(
            *KEY, "c.source", "c.lang", "c.n_tokens", (F.col("c.op") == "delete").alias("gone"), F.lit(len(done)).cast("long").alias("turn")
        ).write.mode("overwrite").parquet(ledger)
        new = self.spark.read.schema(LEDGER).parquet(ledger)
        held = self._read("ledger", LEDGER, done)
        state = F.struct("turn", "source", "lang", "n_tokens", "gone")
        old = held.join(new.select(*KEY), KEY, "left_semi").groupBy(*KEY).agg(F.max(state).alias("s")).select(*KEY, "s.*")
        minus = old.where("not gone").select(*BY, F.lit(-1).alias("docs"), (-F.col("n_tokens")).alias("tokens"))
        plus = new.where("not gone").select(*BY, F.lit(1).alias("docs"), F.col("n_tokens").alias("tokens"))
        sums = plus.union(minus).groupBy(*BY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.where("docs <> 0 or tokens <> 0").write.mode("overwrite").parquet(f"{self.folder}/deltas/{batch}")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens) over all committed batches; groups without documents are gone."""
        deltas = self._read("deltas", DELTAS, self._batches("deltas"))
        return (
            deltas.groupBy(*BY)
            .agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
            .where("n_docs > 0")
        )


def changes(docs: DataFrame, op: str, version: str, count: Column | None = None, seq: int = 0) -> DataFrame:
    """The same change for every document."""
    return docs.select(
        F.lit(op).alias("op"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.lit(version).alias("version"),
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        (F.lit(None) if count is None else count).cast("long").alias("n_tokens"),
        F.lit(seq).cast("long").alias("seq"),
    )


def repeats(docs: DataFrame) -> DataFrame:
    """Documents whose exact text a smaller id has (null texts repeat nothing)."""
    marked = docs.where("text is not null").select("doc_id", "source", "lang", F.sha2("text", 256).alias("digest"))
    first = marked.groupBy("digest").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")).where("n > 1")
    return marked.join(first, "digest").where("doc_id > low").select("doc_id", "source", "lang")

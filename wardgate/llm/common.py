"""Small helpers the operators share."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with its SQL twin where SQL can express it."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_part(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``: the fold of a document (null id: null)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(parts)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the warehouse where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/llm-{label}-{uuid.uuid4().hex}"


_FOLDERS = weakref.WeakKeyDictionary()  # of landed tables


def landed(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage is cut, lost executors cost nothing."""
    folder = new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    _FOLDERS[out] = folder
    return out


def dropped(*landed_tables: DataFrame) -> None:
    """Removes landed tables that nothing reads any more."""
    for df in landed_tables:
        folder = _FOLDERS.pop(df, None)
        if folder is not None:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)

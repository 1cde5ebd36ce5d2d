"""Scans of structured record files: CSV, JSON, XML, and the stored table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardgate.functions import vocab as v

# All text: types are settled by the operators, so a file never decides them.
RECORD = T.StructType([T.StructField(f, T.StringType()) for f in v.CANONICAL])
CORRUPT = "_corrupt"


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])


def read_csv(spark: SparkSession, path: str, schema: T.StructType = RECORD) -> DataFrame:
    """CSV with a header that must match the schema; quotes inside quoted fields are doubled, as
    JSON payloads need."""
    return spark.read.csv(
        path, schema=schema, header=True, escape='"', multiLine=False, enforceSchema=False
    )


def read_csv_as_named(spark: SparkSession, path: str) -> DataFrame:
    """CSV under its own header, every column text."""
    return spark.read.csv(path, header=True, escape='"', inferSchema=False)


def read_json(
    spark: SparkSession, path: str, schema: T.StructType = RECORD, multi_line: bool = False
) -> DataFrame:
    """JSON lines (splittable), or one array or object per file with ``multi_line``."""
    return spark.read.json(path, schema=schema, multiLine=multi_line)


def json_records(
    docs: DataFrame, body: str = "body", keys: Iterable[str] = v.JSON_ENVELOPES,
    schema: T.StructType = RECORD,
) -> DataFrame:
    """One row per record of JSON documents: arrays, enveloped arrays, or a single object.

    The document is parsed once with an explicit schema; the first envelope key present decides.
    """
    records = T.ArrayType(schema)
    shape = T.StructType([*schema.fields, *[T.StructField(k, records) for k in keys]])
    text = F.ltrim(F.col(body))
    whole = F.when(text.startswith("{") & F.rtrim(text).endswith("}"), text)
    rest = [c for c in docs.columns if c != body]
    return (
        docs.withColumn("_list", F.when(text.startswith("["), F.from_json(text, records)))
        .withColumn("_doc", F.from_json(whole, shape))
        .withColumn(
            "_records",
            F.coalesce(
                "_list",
                *[F.col(f"_doc.{k}") for k in keys],
                F.when(
                    F.col("_doc").isNotNull(),
                    F.array(F.struct(*[F.col(f"_doc.{f.name}").alias(f.name) for f in schema])),
                ),
            ),
        )
        .select(*rest, F.explode_outer("_records").alias("_r"))
        .filter(F.col("_r").isNotNull())
        .select(*rest, "_r.*")
    )


def read_xml(
    spark: SparkSession,
    path: str,
    row_tag: str = "patient",
    schema: T.StructType = RECORD,
    **options: str,
) -> DataFrame:
    """One row per ``row_tag`` element.  Types are given, never inferred."""
    reader = spark.read.format("xml").schema(schema).options(rowTag=row_tag, **options)
    return reader.load(path)


def read_xml_any_tag(
    spark: SparkSession,
    path: str,
    tags: Iterable[str] = v.XML_RECORD_TAGS,
    schema: T.StructType = RECORD,
    **options: str,
) -> DataFrame:
    """As :func:`read_xml`, by the first record tag that occurs in the files."""
    last = None
    for tag in tags:
        last = read_xml(spark, path, tag, schema, **options)
        if not last.isEmpty():
            break
    return last


def accepted_and_rejected(
    docs: DataFrame, body: str = "body", schema: T.StructType = RECORD
) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of JSON lines.  A bad line goes to the rejects with its text; it neither
    fails the batch nor vanishes."""
    parsed = docs.withColumn(
        "_r",
        F.from_json(
            body, _with_corrupt(schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
        ),
    )
    bad = F.col("_r").isNull() | F.col(f"_r.{CORRUPT}").isNotNull()
    rest = [c for c in docs.columns if c != body]
    good = parsed.filter(~bad).select(*rest, *[F.col(f"_r.{f.name}") for f in schema])
    return good, parsed.filter(bad).select(*docs.columns)

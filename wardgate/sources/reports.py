"""Text reports to records.

Bodies are text columns, one document per row, however they were landed.  Whole documents are
searched.  Every field is a chain of built-in pattern expressions; nothing leaves the JVM.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardgate.functions import text as t
from wardgate.functions import vocab as v


def read_documents(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """``doc_id`` (file path), ``body``: one row per file, or per piece when a separator is given.

    With a separator the files are split, so a file of any size is read by many tasks.  Without, a task holds a whole
    file, which suits small files alone.
    """
    return (
        spark.read.text(path, wholetext=separator is None, lineSep=separator)
        .select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("body"))
    )


def unix_lines(body: Column) -> Column:
    return F.regexp_replace(body, "\r\n?", "\n")


def block_fields(block: str) -> dict[str, Column]:
    """The labelled values of a block; null where a label or its value is missing."""
    return {
        f: F.nullif(t.strip(F.regexp_extract(block, pattern, 1)), F.lit(""))
        for f, pattern in v.BLOCK_LABELS.items()
    }


def labelled_blocks(docs: DataFrame, body: str = "body") -> DataFrame:
    """One record per labelled block; a block without any known label is dropped."""
    pieces = F.split(unix_lines(F.col(body)), v.BLOCK_SEPARATOR)
    rest = [c for c in docs.columns if c != body]
    fields = block_fields("_block")
    records = docs.select(*rest, F.explode_outer(pieces).alias("_block")).select(
        *rest, *[c.alias(f) for f, c in fields.items()]
    )
    return records.filter(F.coalesce(*fields).isNotNull()).withColumn(
        "bill_amount", F.col("bill_amount").try_cast("double")
    )


def _json_member(name: str, value: Column) -> Column:
    return F.to_json(F.struct(value.alias(name)))


def _cut(text: Column, chars: int | None) -> Column:
    return text if chars is None else F.left(text, F.lit(chars))


def text_report(
    docs: DataFrame,
    body: str = "body",
    stem: str = "doc_id",
    payload_chars: int | None = None,
) -> DataFrame:
    """One record per free-text report; the report itself becomes the payload."""
    text = F.col(body)
    name = t.first_line(t.strip(t.first_match(text, v.REPORT_NAME)))
    consent = F.upper(t.first_match(text, v.REPORT_CONSENT))
    return docs.select(
        stem,
        F.coalesce(name, F.lit("Unknown")).alias("patient_name"),
        t.strip(t.first_match(text, v.REPORT_ID)).alias("abha_id"),
        F.translate(t.first_match(text, v.REPORT_DATE), "/", "-").alias("notice_date"),
        F.coalesce(consent, F.lit("ACTIVE")).alias("consent_status"),
        F.coalesce(
            t.strip(t.first_match(text, v.REPORT_NOTICE)), F.col(stem).cast("string")
        ).alias("notice_id"),
        _json_member("report", _cut(text, payload_chars)).alias("clinical_payload"),
    )


def pdf_text(
    docs: DataFrame,
    body: str = "body",
    stem: str = "doc_id",
    payload_chars: int | None = None,
) -> DataFrame:
    """One record per text taken from a PDF; day-first dates become ISO."""
    text = F.col(body)
    name = F.nullif(t.first_line(t.strip(t.first_match(text, v.PDF_NAME))), F.lit(""))
    day = F.translate(t.first_match(text, v.PDF_DATE), "/", "-")
    return docs.select(
        stem,
        F.coalesce(name, F.lit("Unknown/Redacted")).alias("patient_name"),
        t.strip(t.first_match(text, v.REPORT_ID)).alias("abha_id"),
        F.regexp_replace(day, r"^([0-9]{2})-([0-9]{2})-([0-9]{4})$", "$3-$2-$1").alias(
            "notice_date"
        ),
        F.lit("ACTIVE").alias("consent_status"),
        F.coalesce(
            t.strip(t.first_match(text, v.PDF_NOTICE)), F.col(stem).cast("string")
        ).alias("notice_id"),
        _json_member("text", _cut(text, payload_chars)).alias("clinical_payload"),
    )


def pdf_summary(
    docs: DataFrame,
    as_of: datetime,
    body: str = "body",
    stem: str = "doc_id",
    payload_chars: int | None = None,
) -> DataFrame:
    """Short record of a PDF text: its finding, or the text itself, as the payload.

    The notice id ends in a hash of the document's name, so that documents of one run stay apart.
    """
    text = F.col(body)
    titled = F.nullif(F.regexp_extract(text, v.SUMMARY_TITLE_NAME, 0), F.lit(""))
    hyphened = F.replace(t.first_match(text, [v.SUMMARY_ID]), F.lit(" "), F.lit("-"))
    opening = F.concat(F.translate(_cut(text, payload_chars), "\n", " "), F.lit("..."))
    finding = t.strip(F.regexp_extract(text, v.SUMMARY_FINDING, 1))
    return docs.select(
        stem,
        t.strip(F.coalesce(t.first_match(text, [v.SUMMARY_NAME]), titled)).alias("patient_name"),
        F.coalesce(hyphened, t.first_match(text, [v.SUMMARY_ADDRESS])).alias("abha_id"),
        F.when(text.rlike(v.SUMMARY_FINDING), finding).otherwise(opening).alias(
            "clinical_payload"
        ),
        F.concat(
            F.lit(f"N-2026-PDF-{as_of:%H%M%S}-"), F.left(F.md5(F.col(stem).cast("string")), F.lit(12))
        ).alias("notice_id"),
        F.lit(as_of.date().isoformat()).alias("notice_date"),
        F.lit("GRANTED").alias("consent_status"),
    )

"""HL7 v2 messages and imaging header dumps to records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardgate.functions import text as t


def _nth(fields: Column, i: int) -> Column:
    """Field by zero-based index, null when the segment is shorter or the field is empty."""
    return F.nullif(F.get(fields, F.lit(i)), F.lit(""))


def _segment(segments: Column, kind: str) -> Column:
    """Fields of the first segment of a kind."""
    found = F.filter(segments, lambda s: s.startswith(f"{kind}|"))
    return F.split(F.get(found, F.lit(0)), r"\|")


MESSAGE_START = "MSH|"


def read_hl7(spark: SparkSession, path: str, line_break: str = "\n") -> DataFrame:
    """``doc_id`` (file path), ``body``: one row per message, for files that hold messages only.

    Files are cut at message headers that start a line while they are read, so that a file of any
    size is read by many tasks; what stands before the first header is a preamble and no message.
    ``line_break`` is the character a line ends in.  Documents of unknown content go through
    ``reports.read_documents`` instead.
    """
    pieces = spark.read.text(path, lineSep=f"{line_break}{MESSAGE_START}")
    first = F.col("value").startswith(MESSAGE_START)
    # A piece after a cut starts with the encoding characters, which no other segment does.
    cut = F.col("value").rlike(r"^[^A-Za-z0-9\s]{3,5}(\||$)")
    body = F.when(first, F.col("value")).when(cut, F.concat(F.lit(MESSAGE_START), "value"))
    return pieces.select(F.col("_metadata.file_path").alias("doc_id"), body.alias("body")).filter(
        F.col("body").isNotNull()
    )


def hl7_records(docs: DataFrame, body: str = "body", stem: str = "doc_id") -> DataFrame:
    """One record per message: PID-3 id, PID-5 name, MSH-10 notice, MSH-7 date, MSH-9 as payload.

    Segments end in any line break, and a message starts where a line does.  A document without a message yields one record with its raw
    text, so nothing landed goes missing.  The date in PID field 8 and the consent in PV1 field 20,
    which some senders fill, come along as ``pid_date`` and ``pv1_consent``.
    """
    messages = F.filter(
        F.split(F.ltrim(body), r"(?m)^(?=MSH\|)"), lambda m: m.startswith(MESSAGE_START)
    )
    # Two steps, so that a document's text does not ride along with each of its messages.
    found = docs.withColumn("_list", messages)
    raw_text = F.when(F.size("_list") == 0, F.col(body))
    slim = found.select(stem, raw_text.alias("_raw"), "_list")
    exploded = slim.select(stem, "_raw", F.explode_outer("_list").alias("_msg"))
    segments = F.split(F.col("_msg"), r"[\r\n]+")
    fields = exploded.select(
        stem,
        "_raw",
        F.col("_msg").isNotNull().alias("_is"),
        *[_segment(segments, k).alias(f"_{k.lower()}") for k in ("MSH", "PID", "PV1")],
    )
    # MSH-1 is the separator itself, so MSH-n sits at index n-1 and PID-n at index n.
    name = F.concat_ws(
        " ", F.filter(F.slice(F.split(F.get("_pid", F.lit(5)), r"\^"), 1, 2), lambda x: x != "")
    )
    stamp = _nth(F.col("_msh"), 6)
    day = F.when(F.length(stamp) >= 8, _iso_day(stamp))
    kind = F.to_json(
        F.struct(_nth(F.col("_msh"), 8).alias("message_type")), {"ignoreNullFields": "false"}
    )
    raw = F.to_json(F.struct(F.col("_raw").alias("raw_message")))
    out = fields.select(
        stem,
        F.when(F.col("_is"), F.nullif(name, F.lit(""))).otherwise("Unknown/Redacted").alias(
            "patient_name"
        ),
        F.substring_index(_nth(F.col("_pid"), 3), "^", 1).alias("abha_id"),
        F.when(F.col("_is"), _nth(F.col("_msh"), 9))
        .otherwise(F.col(stem).cast("string"))
        .alias("notice_id"),
        day.alias("notice_date"),
        F.lit("ACTIVE").alias("consent_status"),
        F.when(F.col("_is"), kind).otherwise(raw).alias("clinical_payload"),
        _iso_day(_nth(F.col("_pid"), 8)).alias("pid_date"),
        _nth(F.col("_pv1"), 20).alias("pv1_consent"),
    )
    texts = ("patient_name", "abha_id", "notice_id", "notice_date", "consent_status")
    return out.withColumns({c: t.without_null_tokens(F.col(c)) for c in texts})


def _iso_day(compact: Column) -> Column:
    """First eight digits with hyphens; null stays null."""
    y, m, d = (F.substring(compact, a, n) for a, n in ((1, 4), (5, 2), (7, 2)))
    return F.concat(y, F.lit("-"), m, F.lit("-"), d)


# Header tags of the imaging dump.
IMAGING_TAGS = {
    "patient_name": r"\(0010,0010\)[^:\n]*: ?(.*)",
    "abha_id": r"\(0010,0020\)[^:\n]*: ?(.*)",
    "study_date": r"\(0008,0020\)[^:\n]*: ?(.*)",
    "notice_id": r"\(0020,000D\)[^:\n]*: ?(.*)",
    "study_description": r"\(0008,1030\)[^:\n]*: ?(.*)",
    "modality": r"\(0008,0060\)[^:\n]*: ?(.*)",
    "body_part": r"\(0018,0015\)[^:\n]*: ?(.*)",
}
CLINICAL_TAGS = ("study_description", "modality", "body_part")


def block_tags(block: str) -> dict[str, Column]:
    """The values of the header tags in a block of a dump."""
    return {f: F.nullif(t.strip(F.regexp_extract(block, p, 1)), F.lit("")) for f, p in IMAGING_TAGS.items()}


def imaging_records(docs: DataFrame, body: str = "body", stem: str = "doc_id") -> DataFrame:
    """One record per header block of a tag dump; clinical tags become a JSON payload."""
    blocks = F.split(F.regexp_replace(F.col(body), "\r\n?", "\n"), r"(?m)^---\n?")
    tags = docs.select(stem, F.explode_outer(blocks).alias("_b")).select(
        stem, *[c.alias(f) for f, c in block_tags("_b").items()]
    )
    clinical = F.when(F.coalesce(*CLINICAL_TAGS).isNotNull(), F.to_json(F.struct(*CLINICAL_TAGS)))
    return tags.filter(F.coalesce(*IMAGING_TAGS).isNotNull()).select(
        stem,
        "patient_name",
        "abha_id",
        F.col("study_date").alias("notice_date"),
        "notice_id",
        clinical.alias("clinical_payload"),
        F.lit("ACTIVE").alias("consent_status"),
    )

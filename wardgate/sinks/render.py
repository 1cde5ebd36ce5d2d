"""Records as labelled text, HL7 v2, FHIR, imaging dumps, XML and JSON."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardgate.functions import vocab as v


def _written(name: str) -> Column:
    """A value as text; null is written out as ``None``."""
    return F.coalesce(F.col(name).cast("string"), F.lit("None"))


# Labels and separators of the two text layouts.
TEXT_LABELS = (
    ("Patient Name", "patient_name"),
    ("ABHA ID", "abha_id"),
    ("Notice ID", "notice_id"),
    ("Notice Date", "notice_date"),
    ("Bill Amount", "bill_amount"),
    ("Consent Status", "consent_status"),
    ("Clinical Payload", "clinical_payload"),
)
TEXT_SEPARATOR = "=" * 50
PDF_TEXT_SEPARATOR = "-" * 50


def labelled_text(separator: str = TEXT_SEPARATOR) -> Column:
    """One labelled block, its separator line last."""
    lines = [F.concat(F.lit(f"{label}: "), _written(c)) for label, c in TEXT_LABELS]
    return F.concat_ws("\n", *lines, F.lit(separator))


def hl7_message(sent: datetime) -> Column:
    """MSH, PID and PV1 segments of one record, each ended by a carriage return."""
    msh = [
        F.lit(f"MSH|^~\\&|HIS|HOSPITAL|ADT|HOSPITAL|{sent:%Y%m%d%H%M%S}||ADT^A08^ADT_A01|"),
        _written("notice_id"),
        F.lit("|P|2.5\r"),
    ]
    pid = [
        F.lit("PID|1||"),
        _written("abha_id"),
        F.lit("||"),
        _written("patient_name"),
        F.lit("^^^^|||"),
        F.replace(_written("notice_date"), F.lit("-"), F.lit("")),
        F.lit("|||M\r"),
    ]
    pv1 = [F.lit("PV1|1|I|ICU^ICU^1" + "|" * 17), _written("consent_status"), F.lit("\r")]
    return F.concat(*msh, *pid, *pv1)


def imaging_block() -> Column:
    """Header tags of one record, ended by a ``---`` line."""
    lines = (
        ("(0010,0010) Patient Name: ", _written("patient_name")),
        ("(0010,0020) Patient ID: ", _written("abha_id")),
        ("(0008,0020) Study Date: ", F.replace(_written("notice_date"), F.lit("-"), F.lit(""))),
        ("(0020,000D) Study Instance UID: ", _written("notice_id")),
        ("(0008,1030) Study Description: ", _written("clinical_payload")),
    )
    return F.concat_ws("\n", *[F.concat(F.lit(a), b) for a, b in lines], F.lit("---"))


def _json(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def fhir_patient() -> Column:
    """Patient resource: a typed identifier without value, then the id; family and given name.

    A record without a name gives a resource without the ``name`` member.
    """
    parts = F.split(F.col("patient_name"), "_")
    split = F.size(parts) > 1
    coding = F.struct(
        F.lit("http://terminology.hl7.org/CodeSystem/v2-0203").alias("system"),
        F.lit("MR").alias("code"),
        F.lit("Medical Record Number").alias("display"),
    )
    name = F.struct(
        F.get(parts, F.lit(0)).alias("family"),
        F.array(F.when(split, F.get(parts, F.lit(1))).otherwise("")).alias("given"),
    )
    typed = F.concat(
        F.lit('[{"type":{"coding":['), _json(coding), F.lit("]}},"),
        _json(F.struct(F.col("abha_id").alias("value"))), F.lit("]"),
    )
    return F.concat(
        F.lit('{"resourceType":"Patient","id":'), _quoted(F.col("notice_id")),
        F.lit(',"identifier":'), typed,
        F.when(
            F.col("patient_name").isNotNull(), F.concat(F.lit(',"name":['), _json(name), F.lit("]"))
        ).otherwise(""),
        F.lit("}"),
    )


def _quoted(text: Column) -> Column:
    """A JSON string literal."""
    return F.regexp_extract(_json(F.struct(text.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)


def fhir_consent() -> Column:
    """Consent resource that points at the patient."""
    return _json(
        F.struct(
            F.lit("Consent").alias("resourceType"),
            F.concat(F.lit("consent-"), "notice_id").alias("id"),
            F.lower("consent_status").alias("status"),
            F.struct(F.concat(F.lit("Patient/"), "notice_id").alias("reference")).alias("patient"),
            F.col("notice_date").alias("dateTime"),
        )
    )


def fhir_entries() -> Column:
    """Patient and Consent as two bundle entries, comma-separated."""
    return F.concat(
        F.lit('{"resource":'), fhir_patient(), F.lit('},{"resource":'), fhir_consent(), F.lit("}")
    )


def documents(
    records: DataFrame, chunk: Column, order: str, body: Column, joiner: str = "\n",
    head: str = "", tail: str = "",
) -> DataFrame:
    """``doc_id``, ``body``: records of a chunk in one document.

    ``chunk`` must bound the number of records per document, for instance a key divided by 50.
    """
    pieces = F.array_sort(F.collect_list(F.struct(F.col(order), body.alias("b"))))
    joined = F.concat_ws(joiner, F.transform(pieces, lambda p: p["b"]))
    return records.groupBy(chunk.alias("doc_id")).agg(
        F.concat(F.lit(head), joined, F.lit(tail)).alias("body")
    )


BUNDLE_HEAD = '{"resourceType":"Bundle","type":"collection","entry":['
BUNDLE_TAIL = "]}"


def write_text(docs: DataFrame, path: str, body: str = "body", separator: str = "\n") -> None:
    docs.select(body).write.option("lineSep", separator).text(path)


def write_xml(records: DataFrame, path: str) -> None:
    """``patients`` / ``patient`` elements; null is written out as ``None``."""
    cols = [_written(f).alias(f) for f in v.CANONICAL]
    records.select(*cols).write.format("xml").options(rootTag="patients", rowTag="patient").save(path)


def write_json(records: DataFrame, path: str) -> None:
    """JSON lines with nulls kept."""
    records.select(*v.CANONICAL).write.option("ignoreNullFields", "false").json(path)


def write_csv(records: DataFrame, path: str) -> None:
    """CSV with a header; quotes are doubled, so JSON payloads survive."""
    records.write.options(header=True, escape='"').csv(path)

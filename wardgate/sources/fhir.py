"""FHIR bundles and single resources to records, by explicit schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardgate.functions import text as t

# The members of a resource that are read.
RESOURCE = ", ".join(
    (
        "resourceType: string",
        "id: string",
        "status: string",
        "date: string",
        "dateTime: string",
        "meta: struct<lastUpdated: string>",
        "name: array<struct<text: string, family: string, given: array<string>>>",
        "identifier: array<struct<value: string>>",
        "patient: struct<reference: string>",
        "code: struct<coding: array<struct<display: string>>>",
    )
)
BUNDLE = f"struct<{RESOURCE}, entry: array<struct<resource: struct<{RESOURCE}>>>>"

MEMBERS = (
    "resourceType", "id", "status", "date", "dateTime",
    "meta", "name", "identifier", "patient", "code",
)
CLINICAL_KINDS = ("Observation", "DiagnosticReport", "Condition")


def resources(docs: DataFrame, body: str = "body", stem: str = "doc_id") -> DataFrame:
    """``stem``, ``r``: the resources of bundles, or the document itself when it is one resource."""
    doc = docs.select(stem, F.from_json(body, BUNDLE).alias("_d"))
    listed = F.when(
        F.col("_d.resourceType") == "Bundle", F.transform("_d.entry", lambda e: e["resource"])
    ).when(
        F.col("_d.resourceType").isNotNull(),
        F.array(F.struct(*[F.col(f"_d.{c}").alias(c) for c in MEMBERS])),
    )
    return doc.select(stem, F.explode_outer(listed).alias("r")).filter(F.col("r").isNotNull())


def _first_identifier(identifiers: Column) -> Column:
    valued = F.filter(identifiers, lambda i: F.coalesce(i["value"] != "", F.lit(False)))
    return F.get(valued, F.lit(0))["value"]


def records(docs: DataFrame, body: str = "body", stem: str = "doc_id") -> DataFrame:
    """One record per resource: patients give name and id, consents status, findings a payload."""
    r = F.col("r")
    kind = r["resourceType"]
    first_name = F.get(r["name"], F.lit(0))
    full_name = F.concat_ws(" ", first_name["given"], first_name["family"])
    finding = F.to_json(
        F.struct(
            kind.alias("resource_type"),
            F.get(r["code"]["coding"], F.lit(0))["display"].alias("code"),
            r["status"].alias("status"),
        ),
        {"ignoreNullFields": "false"},
    )
    out = resources(docs, body, stem).select(
        stem,
        kind.alias("resource_type"),
        F.when(kind == "Patient", F.nullif(full_name, F.lit("")))
        .when(kind == "Consent", F.substring_index(r["patient"]["reference"], "/", -1))
        .alias("patient_name"),
        F.when(kind == "Patient", _first_identifier(r["identifier"])).alias("abha_id"),
        F.when(kind.isin(*CLINICAL_KINDS), finding).alias("clinical_payload"),
        F.when(kind == "Consent", F.coalesce(r["status"], F.lit("ACTIVE")))
        .otherwise("ACTIVE")
        .alias("consent_status"),
        r["id"].alias("notice_id"),
        F.coalesce(r["date"], r["dateTime"], F.left(r["meta"]["lastUpdated"], F.lit(10))).alias(
            "notice_date"
        ),
    )
    texts = ("patient_name", "abha_id", "notice_id", "notice_date", "consent_status")
    return out.withColumns({c: t.without_null_tokens(F.col(c)) for c in texts})

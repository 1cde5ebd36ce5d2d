"""Record disposition under the three rule policies, and the desks that work on the outcome.

The policies disagree on purpose (identifier rule, expiry, purpose, evidence) and stay separate.
Each is a projection: no shuffle, no Python, rows independent of one another.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardgate.functions import privacy as p
from wardgate.functions import rules as r
from wardgate.functions import vocab as v


def apply_gate(df: DataFrame) -> DataFrame:
    """Current policy: identifier, consent, and clinical evidence behind high bills.

    In stages: first the flags, whose tests are then evaluated once per row, then what follows
    from them.  Status and reason do not refer to each other, so a filter on either one that is
    pushed below the projection repeats as little as possible.
    """
    valid, revoked = F.col("abha_valid"), r.is_revoked(F.col("consent_status"))
    unproven = r.is_true(F.col("bill_amount") > v.BILL_NEEDS_EVIDENCE_ABOVE) & ~F.col(
        "surgical_truth"
    )
    flags = {
        "abha_valid": r.id_is_valid(F.col("abha_id")),
        "surgical_truth": r.has_clinical_evidence("clinical_payload", "_lower"),
    }
    staged = df.withColumn("_lower", F.lower("clinical_payload")).withColumns(flags).drop("_lower")
    return staged.withColumns(
        {
            "abha_id": r.normalized_id(F.col("abha_id"), valid),
            "status_reason": F.when(unproven, "PENDING_CLINICAL_AUDIT")
            .when(revoked, "CONSENT_REVOKED")
            .when(~valid, "MISSING_ABHA")
            .otherwise("N/A"),
            "ingest_status": F.when(~valid | unproven, "QUARANTINED")
            .when(revoked, "PURGED")
            .otherwise("PROCESSED"),
        }
    )


def gate_status_before_audit(df: DataFrame) -> DataFrame:
    """Status from identifier and consent alone, before high bills are held back."""
    return df.withColumn(
        "ingest_status",
        F.when(~r.id_is_valid(F.col("abha_id")), "QUARANTINED")
        .when(r.is_revoked(F.col("consent_status")), "PURGED")
        .otherwise("PROCESSED"),
    )


def apply_intake_v1(df: DataFrame, as_of: datetime, days: int = v.RETENTION_DAYS) -> DataFrame:
    """First policy: wider identifiers, retention and legacy notices, no evidence rule."""
    id_, consent = F.col("abha_id"), F.col("consent_status")
    expired = F.col("notice_date") < r.cutoff(as_of, days)
    legacy = r.notice_is_legacy(F.col("notice_id"))
    accepted = r.id_is_accepted_v1(id_)
    return (
        df.withColumn("notice_date", r.strict_date(F.col("notice_date").cast("string"), as_of))
        .withColumn(
            "status_reason",
            F.when(r.id_is_missing(id_), "MISSING_ABHA")
            .when(~accepted, "MALFORMED_ID")
            .when(r.is_revoked(consent), "CONSENT_REVOKED")
            .when(expired, "NOTICE_EXPIRED")
            .otherwise("N/A"),
        )
        .withColumn(
            "ingest_status",
            F.when(F.col("status_reason").isin("MISSING_ABHA", "MALFORMED_ID"), "QUARANTINED")
            .when((F.col("status_reason") != "N/A") | legacy, "PURGED")
            .otherwise("PROCESSED"),
        )
    )


def apply_erasure_policy(
    df: DataFrame, as_of: datetime, days: int = v.RETENTION_DAYS
) -> DataFrame:
    """Erasure policy: consent, retention and purpose decide the outcome status."""
    reason = r.erasure_reason(
        F.col("consent_status"), F.col("notice_date"), F.col("data_purpose"), as_of, days
    )
    return df.withColumn("erasure_reason", reason).withColumns(
        {
            "evaluation": F.when(F.col("erasure_reason") == "N/A", "PROCESSED").otherwise("PURGED"),
            "outcome": r.erasure_outcome(F.col("erasure_reason"), F.col("consent_status")),
        }
    )


def apply_retention_policy(
    df: DataFrame, as_of: datetime, days: int = v.RETENTION_DAYS
) -> DataFrame:
    """Erasure decision by consent and retention only, whatever the purpose."""
    reason = r.erasure_reason(F.col("consent_status"), F.col("notice_date"), None, as_of, days)
    return df.withColumn("erasure_reason", reason).withColumn(
        "evaluation", F.when(F.col("erasure_reason") == "N/A", "SAFE").otherwise("PURGE_REQUIRED")
    )


# --- erasing ----------------------------------------------------------------------------------


def erase_revoked(df: DataFrame, with_status: bool = False) -> DataFrame:
    """Identity of revoked records becomes a constant; optionally their disposition follows."""
    new = {"patient_name": v.DATA_PURGED, "abha_id": v.DATA_PURGED}
    if with_status:
        new |= {"ingest_status": "PURGED", "status_reason": "CONSENT_REVOKED"}
    revoked = r.is_revoked(F.col("consent_status"))
    return df.withColumns(
        {c: F.when(revoked, x).otherwise(F.col(c)) for c, x in new.items() if c in df.columns}
    )


def wipe_purged(df: DataFrame) -> DataFrame:
    """Overwrite payload, name, id and token of records the erasure policy purges."""
    purged = F.col("evaluation") == "PURGED"
    new = {
        "clinical_payload": v.WIPED_PAYLOAD,
        "patient_name": "REDACTED",
        "abha_id": "REDACTED",
        "consent_token": "PURGED",
    }
    return df.withColumns(
        {
            c: F.when(purged, x).otherwise(
                F.col(c) if c in df.columns else F.lit(None).cast("string")
            )
            for c, x in new.items()
        }
    )


# --- views ------------------------------------------------------------------------------------


def mask_preview(df: DataFrame, reveal: bool = False, revoked: bool = False) -> DataFrame:
    """Masked name, id and payload, on whichever of them are present."""

    def shown(c: str, masked: Column) -> Column:
        if revoked:
            return F.lit(v.DATA_PURGED)
        return F.col(c) if reveal else masked

    masked = {
        "patient_name": lambda c: shown("patient_name", p.mask_name(c)),
        "abha_id": lambda c: shown("abha_id", p.mask_id(c)),
        "clinical_payload": p.mask_payload,
    }
    return df.withColumns({c: f(F.col(c)) for c, f in masked.items() if c in df.columns})


# Which outcome each desk works on, its editable column and its visible columns.
DESKS = {
    "IDENTITY": ("MISSING_ABHA", "abha_id", ("patient_name", "abha_id")),
    "CLINICAL": (
        "PENDING_CLINICAL_AUDIT",
        "clinical_payload",
        ("patient_name", "clinical_payload", "bill_amount"),
    ),
}


def desk_of(status: Column, reason: Column) -> Column:
    """Desk a gated record belongs to; null when none handles it."""
    return (
        F.when(status == "PROCESSED", "VALIDATED")
        .when(reason == "CONSENT_REVOKED", "REVOKED")
        .when(reason == "MISSING_ABHA", "IDENTITY")
        .when(reason == "PENDING_CLINICAL_AUDIT", "CLINICAL")
    )


def desk_view(gated: DataFrame, desk: str, reveal: bool = False) -> DataFrame:
    """A desk's records: all masked but the column it edits."""
    reason, editable, visible = DESKS[desk]
    rows = gated.filter(F.col("status_reason") == reason).withColumn("_edit", F.col(editable))
    others = [c for c in visible if c != editable]
    return mask_preview(rows, reveal).select(
        "notice_id", F.col("_edit").alias(editable), *others
    )


def final_validated(table: DataFrame) -> DataFrame:
    """Stored records whose consent stands; an unknown reason is left out, as in SQL."""
    return table.filter(F.col("status_reason") != "CONSENT_REVOKED")

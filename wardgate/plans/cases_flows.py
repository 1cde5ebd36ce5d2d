"""Queries over whole flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardgate.functions import vocab as v
from wardgate.operators import tables as tb
from wardgate.plans import flows
from wardgate.plans import sql_rules as q
from wardgate.plans.fixtures import fixture, with_fixtures
from wardgate.plans.registry import AS_OF, query
from wardgate.workspace import new_folder

c = F.col
S = q.STORED_COLUMNS

_V1 = f"""SELECT *, coalesce(abha_id = '', true) AS missing,
    coalesce(regexp_matches(abha_id, {q.lit(v.ID_V1)}), false) AS good,
    CAST(notice_date AS TIMESTAMP) < {q.CUTOFF} AS old FROM (
    SELECT notice_id, patient_name, consent_status, notice_date, coalesce(abha_id, replace(nullif(
        regexp_extract(txt, {q.lit(v.RECOVER_ID)}, 0), ''), ' ', '-')) AS abha_id
    FROM (SELECT *, concat_ws(' ', patient_name, abha_id, clinical_payload, CAST(bill_amount AS STRING),
        consent_status, notice_id, notice_date, data_purpose) AS txt FROM intake) t) u"""


@query(
    "flow_intake_v1",
    with_fixtures("intake")
    + f"""SELECT notice_id, patient_name, abha_id,
    CASE WHEN missing OR NOT good THEN 'QUARANTINED'
        WHEN coalesce(consent_status = 'REVOKED', false) OR old
            OR starts_with(notice_id, 'N-2025') THEN 'PURGED' ELSE 'PROCESSED' END AS ingest_status,
    CASE WHEN missing THEN 'MISSING_ABHA' WHEN NOT good THEN 'MALFORMED_ID'
        WHEN consent_status = 'REVOKED' THEN 'CONSENT_REVOKED' WHEN old THEN 'NOTICE_EXPIRED'
        ELSE 'N/A' END AS status_reason FROM ({_V1}) x""",
)
def flow_intake_v1(spark, sf):
    raw = fixture(spark, sf, "intake").withColumnsRenamed(
        {"patient_name": "Pt_Name", "abha_id": "Health_ID", "clinical_payload": "Report"}
    )
    return flows.intake_v1(raw, AS_OF).select(
        "notice_id", "patient_name", "abha_id", "ingest_status", "status_reason"
    )


@query(
    "flow_adapter_batch",
    with_fixtures(
        "intake",
        "registry",
        "links",
        first="SELECT patient_name, abha_id AS rid, consent_status AS rcs FROM registry WHERE reg_seq = 1",
        found="""SELECT i.notice_id, i.patient_name, i.notice_date, i.clinical_payload,
            coalesce(i.abha_id, f.rid, l.abha_id) AS abha_id,
            CASE WHEN i.abha_id IS NULL AND f.rid IS NOT NULL THEN f.rcs ELSE i.consent_status END
                AS consent_status,
            CASE WHEN i.abha_id IS NOT NULL THEN NULL WHEN f.rid IS NOT NULL THEN 'RECOVERED_FROM_DB'
                WHEN l.abha_id IS NOT NULL THEN 'LINKED_BY_GATEWAY' END AS discovery_status
            FROM intake i LEFT JOIN first f ON i.patient_name = f.patient_name
            LEFT JOIN links l ON i.patient_name = l.patient_name""",
        judged=f"""SELECT *, CASE WHEN upper(consent_status) = 'REVOKED' THEN 'CONSENT_REVOKED'
            WHEN CAST(notice_date AS TIMESTAMP) < {q.CUTOFF} THEN 'NOTICE_EXPIRED' ELSE 'N/A' END
            AS erasure_reason FROM found""",
    )
    + f"""SELECT notice_id, consent_status, discovery_status, {q.OUTCOME} AS outcome,
        CASE WHEN erasure_reason <> 'N/A' THEN 'REDACTED' ELSE patient_name END AS patient_name,
        CASE WHEN erasure_reason <> 'N/A' THEN 'REDACTED' ELSE abha_id END AS abha_id,
        {q.member('clinical_payload', 'visit_type', 'UNKNOWN')} AS visit_type,
        {q.snomed(q.member('clinical_payload', 'diagnosis', ''), '')} AS snomed_code FROM judged""",
)
def flow_adapter_batch(spark, sf):
    raw = fixture(spark, sf, "intake").withColumnsRenamed(
        {"patient_name": "Member Name", "abha_id": "uhid", "clinical_payload": "case-data"}
    )
    out = flows.adapter_batch(
        raw, AS_OF, fixture(spark, sf, "registry"), fixture(spark, sf, "links")
    )
    return out.select(
        "notice_id", "consent_status", "discovery_status", "outcome", "patient_name", "abha_id",
        "visit_type", "snomed_code",
    )


@query(
    "flow_adapter_landing",
    with_fixtures(
        "intake",
        "registry",
        "links",
        first="SELECT patient_name, abha_id AS rid, consent_status AS rcs FROM registry WHERE reg_seq = 1",
        found="""SELECT i.notice_id, i.patient_name, i.notice_date, i.clinical_payload,
            coalesce(i.abha_id, f.rid, l.abha_id) AS abha_id,
            CASE WHEN i.abha_id IS NULL AND f.rid IS NOT NULL THEN f.rcs ELSE i.consent_status END
                AS consent_status,
            CASE WHEN i.abha_id IS NOT NULL THEN NULL WHEN f.rid IS NOT NULL THEN 'RECOVERED_FROM_DB'
                WHEN l.abha_id IS NOT NULL THEN 'LINKED_BY_GATEWAY' END AS discovery_status
            FROM intake i LEFT JOIN first f ON i.patient_name = f.patient_name
            LEFT JOIN links l ON i.patient_name = l.patient_name""",
        judged=f"""SELECT *, CASE WHEN upper(consent_status) = 'REVOKED' THEN 'CONSENT_REVOKED'
            WHEN CAST(notice_date AS TIMESTAMP) < {q.CUTOFF} THEN 'NOTICE_EXPIRED' ELSE 'N/A' END
            AS erasure_reason FROM found""",
    )
    + f"""SELECT notice_id, consent_status, discovery_status, {q.OUTCOME} AS outcome,
        CASE WHEN erasure_reason <> 'N/A' THEN 'REDACTED' ELSE patient_name END AS patient_name,
        CASE WHEN erasure_reason <> 'N/A' THEN 'REDACTED' ELSE abha_id END AS abha_id,
        {q.member('clinical_payload', 'visit_type', 'UNKNOWN')} AS visit_type,
        {q.snomed(q.member('clinical_payload', 'diagnosis', ''), '')} AS snomed_code FROM judged""",
)
def flow_adapter_landing(spark, sf):
    """The adapter batch over landed files: three kinds, each with its own spelling of the headers."""
    root = new_folder(spark, "adapter")
    fields = ["patient_name", "abha_id", "clinical_payload", "consent_status", "notice_id", "notice_date", "data_purpose"]
    base = fixture(spark, sf, "base").withColumn("kind", c("k") % 3)
    names = {"patient_name": "Member Name", "abha_id": "uhid", "clinical_payload": "case-data"}
    shown = [c(f).alias(names.get(f, f)) for f in fields]
    base.filter("kind = 0").select(*shown).write.options(header=True, escape='"').csv(f"{root}/a")
    base.filter("kind = 1").select(*reversed(shown)).write.options(header=True, escape='"').csv(f"{root}/b")
    base.filter("kind = 2").select(*shown).write.json(f"{root}/c")
    out, _ = flows.adapter_landing(
        spark, root, AS_OF, fixture(spark, sf, "registry"), fixture(spark, sf, "links")
    )
    return out.select(
        "notice_id", "consent_status", "discovery_status", "outcome", "patient_name", "abha_id",
        "visit_type", "snomed_code",
    )


@query(
    "flow_desk_corrections",
    with_fixtures(
        "intake",
        "corrections",
        gated=q.gated(),
        corrected="""SELECT g.* EXCLUDE (abha_valid, surgical_truth, status_reason, ingest_status)
            REPLACE (CASE WHEN g.status_reason = 'MISSING_ABHA' THEN coalesce(x.abha_id, g.abha_id)
                ELSE g.abha_id END AS abha_id,
            CASE WHEN g.status_reason = 'PENDING_CLINICAL_AUDIT'
                THEN coalesce(x.clinical_payload, g.clinical_payload) ELSE g.clinical_payload END
                AS clinical_payload)
            FROM gated g LEFT JOIN corrections x USING (notice_id)""",
        again=q.gated("corrected"),
    )
    + f"SELECT {S} FROM again",
)
def flow_desk_corrections(spark, sf):
    root = new_folder(spark, "desk")
    patients = tb.KeyedTable(spark, f"{root}/patients", tb.PATIENTS, "notice_id")
    patients.upsert(tb.to_stored(flows.gate_intake(fixture(spark, sf, "intake")), AS_OF))
    edits = fixture(spark, sf, "corrections")
    # The clinical desk first: its records keep their reason until it has seen them.
    for desk in ("CLINICAL", "IDENTITY"):
        waiting = edits if desk == "CLINICAL" else edits.filter(c("abha_id").isNotNull())
        # An earlier edit of each record, which must not count, and the batch given twice.
        early = waiting.withColumns({"seq": F.lit(0), "abha_id": F.lit("x"), "clinical_payload": F.lit("x")})
        both = waiting.withColumn("seq", F.lit(1)).unionByName(early)
        for _ in range(2):
            flows.correct(patients, both, desk, AS_OF, root, desk, "seq")
    return patients.current().select(*[x.strip() for x in S.split(",")])

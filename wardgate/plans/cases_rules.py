"""Queries over the disposition rules, payload scalars and privacy scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardgate.functions import payload as pl
from wardgate.functions import privacy as p
from wardgate.functions import rules as r
from wardgate.functions import vocab as v
from wardgate.operators import dispositions as d
from wardgate.operators import tables as tb
from wardgate.plans import sql_rules as q
from wardgate.plans.fixtures import fixture, table, with_fixtures
from wardgate.plans.registry import AS_OF, query

c = F.col
INTAKE = with_fixtures("intake")
GATED = with_fixtures("intake", gated=q.gated())
ERASED = with_fixtures("intake", erased=q.ERASED)


# --- V: rules ---------------------------------------------------------------------------------


@query(
    "V1_id_normalized",
    INTAKE
    + """SELECT notice_id, CASE WHEN regexp_matches(s, '^[0-9]{14}$')
        THEN substr(s, 1, 2) || '-' || substr(s, 3, 4) || '-' || substr(s, 7, 4) || '-'
            || substr(s, 11, 4) ELSE raw END AS abha_id
    FROM (SELECT notice_id, coalesce(abha_id, '') AS raw, replace(coalesce(abha_id, ''), '-', '') AS s
        FROM intake) t""",
)
def v1(spark, sf):
    return fixture(spark, sf, "intake").select(
        "notice_id", r.normalized_id(c("abha_id")).alias("abha_id")
    )


@query("V2_id_valid", GATED + "SELECT notice_id, abha_valid FROM gated")
def v2(spark, sf):
    return fixture(spark, sf, "intake").select(
        "notice_id", r.id_is_hyphenated(r.normalized_id(c("abha_id"))).alias("abha_valid")
    )


@query(
    "V3_id_valid_v1",
    INTAKE
    + f"""SELECT notice_id, coalesce(abha_id = '', true) AS missing,
        coalesce(regexp_matches(abha_id, {q.lit(v.ID_V1)}), false) AS accepted FROM intake""",
)
def v3(spark, sf):
    return fixture(spark, sf, "intake").select(
        "notice_id",
        r.id_is_missing(c("abha_id")).alias("missing"),
        r.id_is_accepted_v1(c("abha_id")).alias("accepted"),
    )


@query(
    "V4_id_bare_digits",
    INTAKE
    + """SELECT notice_id, coalesce(length(abha_id) = 14 AND regexp_matches(abha_id, '^[0-9]+$'), false)
        AS bare FROM intake""",
)
def v4(spark, sf):
    return fixture(spark, sf, "intake").select(
        "notice_id", r.id_is_digits(c("abha_id")).alias("bare")
    )


@query("V5_clinical_evidence", GATED + "SELECT notice_id, surgical_truth FROM gated")
def v5(spark, sf):
    return fixture(spark, sf, "intake").select(
        "notice_id", r.has_clinical_evidence("clinical_payload").alias("surgical_truth")
    )


@query(
    "V6_gate_status",
    GATED
    + """SELECT notice_id, CASE WHEN NOT abha_valid THEN 'QUARANTINED'
        WHEN consent_status = 'REVOKED' THEN 'PURGED' ELSE 'PROCESSED' END AS ingest_status
        FROM gated""",
)
def v6(spark, sf):
    return d.gate_status_before_audit(fixture(spark, sf, "intake")).select(
        "notice_id", "ingest_status"
    )


@query("V7_gate_reason", GATED + "SELECT notice_id, status_reason FROM gated")
def v7(spark, sf):
    return d.apply_gate(fixture(spark, sf, "intake")).select("notice_id", "status_reason")


@query(
    "V8_gate_audit_override",
    GATED
    + "SELECT notice_id, ingest_status, status_reason FROM gated",
)
def v8(spark, sf):
    gated = d.apply_gate(fixture(spark, sf, "intake"))
    return gated.select("notice_id", "ingest_status", "status_reason")


V1_POLICY = INTAKE + f"""
SELECT notice_id, CASE WHEN missing OR NOT good THEN 'QUARANTINED'
        WHEN coalesce(consent_status = 'REVOKED', false) OR old
            OR starts_with(notice_id, 'N-2025') THEN 'PURGED' ELSE 'PROCESSED' END AS ingest_status,
    CASE WHEN missing THEN 'MISSING_ABHA' WHEN NOT good THEN 'MALFORMED_ID'
        WHEN consent_status = 'REVOKED' THEN 'CONSENT_REVOKED' WHEN old THEN 'NOTICE_EXPIRED'
        ELSE 'N/A' END AS status_reason
FROM (SELECT *, coalesce(abha_id = '', true) AS missing,
    coalesce(regexp_matches(abha_id, {q.lit(v.ID_V1)}), false) AS good,
    CAST(notice_date AS TIMESTAMP) < {q.CUTOFF} AS old FROM intake) t"""


@query("V9_intake_v1_status", f"SELECT notice_id, ingest_status FROM ({V1_POLICY}) x")
def v9(spark, sf):
    out = d.apply_intake_v1(fixture(spark, sf, "intake"), AS_OF)
    return out.select("notice_id", "ingest_status")


@query("V10_intake_v1_reason", f"SELECT notice_id, status_reason FROM ({V1_POLICY}) x")
def v10(spark, sf):
    out = d.apply_intake_v1(fixture(spark, sf, "intake"), AS_OF)
    return out.select("notice_id", "status_reason")


@query(
    "V11_erasure_evaluation",
    ERASED + "SELECT notice_id, evaluation, erasure_reason FROM erased",
)
def v11(spark, sf):
    out = d.apply_erasure_policy(fixture(spark, sf, "intake"), AS_OF)
    return out.select("notice_id", "evaluation", "erasure_reason")


@query(
    "V12_retention_evaluation",
    INTAKE
    + f"""SELECT notice_id, CASE WHEN why = 'N/A' THEN 'SAFE' ELSE 'PURGE_REQUIRED' END AS evaluation,
        why AS erasure_reason FROM (SELECT notice_id,
            CASE WHEN upper(consent_status) = 'REVOKED' THEN 'CONSENT_REVOKED'
            WHEN CAST(notice_date AS TIMESTAMP) < {q.CUTOFF} THEN 'NOTICE_EXPIRED'
            ELSE 'N/A' END AS why FROM intake) t""",
)
def v12(spark, sf):
    out = d.apply_retention_policy(fixture(spark, sf, "intake"), AS_OF)
    return out.select("notice_id", "evaluation", "erasure_reason")


@query("V13_erasure_outcome", ERASED + "SELECT notice_id, outcome FROM erased")
def v13(spark, sf):
    out = d.apply_erasure_policy(fixture(spark, sf, "intake"), AS_OF)
    return out.select("notice_id", "outcome")


@query(
    "V14_notice_versioned",
    INTAKE
    + f"""SELECT notice_id, regexp_matches(notice_id, {q.lit(v.NOTICE_VERSIONED)}) AS full_ok,
        regexp_matches(regexp_replace(notice_id, '-[0-9]+$', ''), {q.lit(v.NOTICE_VERSIONED)})
            AS version_ok FROM intake""",
)
def v14(spark, sf):
    return fixture(spark, sf, "intake").select(
        "notice_id",
        r.notice_is_versioned(c("notice_id")).alias("full_ok"),
        r.notice_is_versioned(F.regexp_replace("notice_id", "-[0-9]+$", "")).alias("version_ok"),
    )


@query(
    "V15_expired_for_reporting",
    INTAKE
    + f"""SELECT notice_id, CAST(notice_date AS TIMESTAMP) < ({q.AS_OF} - INTERVAL 30 DAY) AS expired
        FROM intake""",
)
def v15(spark, sf):
    expired = r.is_expired(c("notice_date"), AS_OF, v.REPORTING_EXPIRY_DAYS)
    return fixture(spark, sf, "intake").select("notice_id", expired.alias("expired"))


@query(
    "V16_triage_desks",
    GATED
    + """SELECT notice_id, CASE WHEN ingest_status = 'PROCESSED' THEN 'VALIDATED'
        WHEN status_reason = 'CONSENT_REVOKED' THEN 'REVOKED'
        WHEN status_reason = 'MISSING_ABHA' THEN 'IDENTITY' ELSE 'CLINICAL' END AS desk FROM gated""",
)
def v16(spark, sf):
    gated = d.apply_gate(fixture(spark, sf, "intake"))
    return gated.select("notice_id", d.desk_of(c("ingest_status"), c("status_reason")).alias("desk"))


@query("V17_gate", GATED + "SELECT * FROM gated")
def v17(spark, sf):
    return d.apply_gate(fixture(spark, sf, "intake"))


# --- J: payload -------------------------------------------------------------------------------


@query(
    "J1_payload_fields",
    INTAKE
    + f"""SELECT notice_id, {q.member('clinical_payload', 'diagnosis', '')} AS diagnosis,
        {q.member('clinical_payload', 'visit_type', 'UNKNOWN')} AS visit_type FROM intake""",
)
def j1(spark, sf):
    staged = fixture(spark, sf, "intake").withColumn("_o", pl.payload_object(c("clinical_payload")))
    return staged.select(
        "notice_id",
        pl.diagnosis(c("_o")).alias("diagnosis"),
        pl.visit_type(c("_o")).alias("visit_type"),
    )


@query(
    "J2_terminology",
    INTAKE
    + f"""SELECT notice_id, {q.snomed('dx', '')} AS code,
        {q.snomed('dx', v.SNOMED_FALLBACK)} AS export_code
        FROM (SELECT notice_id, {q.member('clinical_payload', 'diagnosis', '')} AS dx FROM intake) t""",
)
def j2(spark, sf):
    dx = pl.diagnosis(pl.payload_object(c("clinical_payload")))
    return (
        fixture(spark, sf, "intake")
        .select("notice_id", dx.alias("dx"))
        .select(
            "notice_id",
            pl.snomed_code(c("dx"), "").alias("code"),
            pl.snomed_code(c("dx"), v.SNOMED_FALLBACK).alias("export_code"),
        )
    )


# Half of the payloads lose their JSON shape, so that the fallback has raw text to look at.
LOOSE = """CASE WHEN k % 2 = 0 THEN replace(clinical_payload, '{', 'note: ') ELSE clinical_payload END"""


@query(
    "J3_visit_type_fallback",
    with_fixtures("base", loose=f"SELECT notice_id, {LOOSE} AS p FROM base")
    + f"""SELECT notice_id, CASE WHEN vt <> 'UNKNOWN' THEN vt WHEN contains(p, 'OPD') THEN 'OPD'
        WHEN contains(p, 'IPD') THEN 'IPD' WHEN contains(p, 'EMERGENCY') THEN 'EMERGENCY'
        WHEN contains(p, 'TELECONSULT') THEN 'TELECONSULT' ELSE 'UNKNOWN' END AS visit_type
        FROM (SELECT *, {q.member('p', 'visit_type', 'UNKNOWN')} AS vt FROM loose) t""",
)
def j3(spark, sf):
    staged = fixture(spark, sf, "base").select("notice_id", F.expr(LOOSE).alias("p"))
    staged = staged.withColumn("_o", pl.payload_object(c("p")))
    return staged.select(
        "notice_id", pl.visit_type_with_fallback(c("_o"), c("p")).alias("visit_type")
    )


@query(
    "J4_condition_text",
    with_fixtures("base", loose=f"SELECT notice_id, {LOOSE} AS p FROM base")
    + """SELECT notice_id, CASE WHEN p IS NULL THEN 'None' WHEN NOT json_valid(p) THEN p
        ELSE coalesce(json_extract_string(p, '$.diagnosis'), 'Unknown Condition') END AS condition
        FROM loose""",
)
def j4(spark, sf):
    return (
        fixture(spark, sf, "base")
        .select("notice_id", F.expr(LOOSE).alias("p"))
        .select("notice_id", pl.condition_text(c("p")).alias("condition"))
    )


RESOURCE = """CASE k % 5 WHEN 0 THEN '{"resourceType":"Patient","name":[{"text":"' || patient_name || '"}]}'
    WHEN 1 THEN '{"resourceType":"Patient","name":[]}'
    WHEN 2 THEN '{"resourceType":"Patient","name":[{"family":"' || patient_name || '"}]}'
    WHEN 3 THEN '{"resourceType":"Consent","id":"' || notice_id || '"}'
    ELSE '{"resourceType":"Patient"}' END"""


@query(
    "J5_patient_structure",
    with_fixtures("base")
    + """SELECT notice_id, k % 5 IN (0, 3) AS ok, k % 5 = 0 AS strict_ok FROM base""",
)
def j5(spark, sf):
    res = fixture(spark, sf, "base").select("notice_id", F.expr(RESOURCE).alias("r"))
    return res.select(
        "notice_id",
        pl.patient_resource_is_named(c("r")).alias("ok"),
        pl.patient_resource_is_named(c("r"), others_pass=False).alias("strict_ok"),
    )


# --- M: privacy -------------------------------------------------------------------------------


@query("M1_id_token", INTAKE + f"SELECT notice_id, {q.token('abha_id')} AS token FROM intake")
def m1(spark, sf):
    return fixture(spark, sf, "intake").select("notice_id", p.id_token(c("abha_id")).alias("token"))


@query(
    "M2_pseudonyms",
    INTAKE
    + f"""SELECT notice_id, 'Pt_' || {q.token('patient_name')} AS patient_name,
        CASE WHEN abha_id IS NULL THEN NULL ELSE 'ABHA_' || {q.token('abha_id')} END AS abha_id
        FROM intake""",
)
def m2(spark, sf):
    return fixture(spark, sf, "intake").select(
        "notice_id",
        p.pseudonym(c("patient_name"), "Pt_").alias("patient_name"),
        p.pseudonym(c("abha_id"), "ABHA_").alias("abha_id"),
    )


@query(
    "M3_mask_short",
    INTAKE
    + """SELECT notice_id, CASE WHEN abha_id IS NULL THEN '[MISSING/REDACTED]'
            ELSE left(abha_id, 2) || '****' || right(abha_id, 2) END AS id_masked,
        CASE WHEN consent_status IS NULL THEN '[MISSING/REDACTED]'
            ELSE left(consent_status, 2) || '****' || right(consent_status, 2) END AS consent_masked,
        CASE WHEN length(tail) < 4 THEN '****' WHEN length(tail) = 4 THEN left(tail, 1) || '****'
            ELSE left(tail, 2) || '****' || right(tail, 2) END AS tail_masked
        FROM (SELECT *, regexp_extract(notice_id, '[0-9]+$', 0) AS tail FROM intake) t""",
)
def m3(spark, sf):
    tail = F.regexp_extract("notice_id", "[0-9]+$", 0)
    return fixture(spark, sf, "intake").select(
        "notice_id",
        p.mask_short(c("abha_id")).alias("id_masked"),
        p.mask_short(c("consent_status")).alias("consent_masked"),
        p.mask_short(tail).alias("tail_masked"),
    )


@query(
    "M4_mask_name",
    with_fixtures("intake")
    + f"""SELECT 'intake' AS src, notice_id AS id, {q.mask_name('patient_name')} AS masked FROM intake
        UNION ALL SELECT 'customer', CAST(c_custkey AS STRING), {q.mask_name('c_name')} FROM customer
        UNION ALL SELECT 'segment', CAST(c_custkey AS STRING),
            {q.mask_name('left(c_mktsegment, CAST(1 + c_custkey % 7 AS INT))')} FROM customer""",
)
def m4(spark, sf):
    own = fixture(spark, sf, "intake").select(
        F.lit("intake").alias("src"), c("notice_id").alias("id"), c("patient_name").alias("x")
    )
    cust = table(spark, sf, "customer")
    key = c("c_custkey").cast("string").alias("id")
    names = cust.select(F.lit("customer").alias("src"), key, c("c_name").alias("x"))
    cut = F.left("c_mktsegment", (1 + c("c_custkey") % 7).cast("int"))
    short = cust.select(F.lit("segment").alias("src"), key, cut.alias("x"))
    return own.unionByName(names).unionByName(short).select(
        "src", "id", p.mask_name(c("x")).alias("masked")
    )


@query(
    "M5_mask_id",
    INTAKE + f"SELECT notice_id, {q.mask_id('abha_id')} AS masked FROM intake",
)
def m5(spark, sf):
    return fixture(spark, sf, "intake").select("notice_id", p.mask_id(c("abha_id")).alias("masked"))


@query(
    "M6_mask_payload",
    INTAKE + f"SELECT notice_id, {q.mask_payload('clinical_payload')} AS masked FROM intake",
)
def m6(spark, sf):
    return fixture(spark, sf, "intake").select(
        "notice_id", p.mask_payload(c("clinical_payload")).alias("masked")
    )


@query(
    "M7_masked_preview",
    GATED
    + f"""SELECT * REPLACE ({q.mask_name('patient_name')} AS patient_name,
        {q.mask_id('abha_id')} AS abha_id, {q.mask_payload('clinical_payload')} AS clinical_payload)
        FROM gated""",
)
def m7(spark, sf):
    gated = d.apply_gate(fixture(spark, sf, "intake"))
    return d.mask_preview(gated)


# Report bodies carry ids, phone-like and twelve-digit numbers, which the prose rarely does.
NOTED = """body || ' call +91' || lpad(CAST(k % 10000000000 AS STRING), 10, '9') || ' or 1234 5678 '
    || lpad(CAST(k % 10000 AS STRING), 4, '0') || ' mail p' || CAST(k AS STRING) || '@ward.example.org'"""


@query(
    "M8_redact_text",
    with_fixtures("reports", r2="SELECT doc_id, doc_id AS k, body FROM reports")
    + f"""SELECT 'documents' AS src, doc_id, {q.redact('text')} AS redacted FROM documents
        UNION ALL SELECT 'reports', doc_id, {q.redact('(' + NOTED + ')')} FROM r2""",
)
def m8(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.lit("documents").alias("src"), "doc_id", c("text").alias("x")
    )
    noted = fixture(spark, sf, "reports").withColumn("k", c("doc_id"))
    noted = noted.select(F.lit("reports").alias("src"), "doc_id", F.expr(NOTED).alias("x"))
    return docs.unionByName(noted).select("src", "doc_id", p.redact_text(c("x")).alias("redacted"))


@query(
    "M9_erase_revoked",
    GATED
    + """SELECT notice_id, CASE WHEN rev THEN '[DATA PURGED]' ELSE patient_name END AS patient_name,
        CASE WHEN rev THEN '[DATA PURGED]' ELSE abha_id END AS abha_id,
        CASE WHEN rev THEN 'PURGED' ELSE ingest_status END AS ingest_status,
        CASE WHEN rev THEN 'CONSENT_REVOKED' ELSE status_reason END AS status_reason
        FROM (SELECT *, coalesce(consent_status = 'REVOKED', false) AS rev FROM gated) t""",
)
def m9(spark, sf):
    gated = d.apply_gate(fixture(spark, sf, "intake"))
    return d.erase_revoked(gated, with_status=True).select(
        "notice_id", "patient_name", "abha_id", "ingest_status", "status_reason"
    )


@query(
    "M10_wipe_purged",
    ERASED
    + """SELECT notice_id, outcome,
        CASE WHEN gone THEN 'PURGED_DPDP_RULE_8_ERASURE' ELSE clinical_payload END AS clinical_payload,
        CASE WHEN gone THEN 'REDACTED' ELSE patient_name END AS patient_name,
        CASE WHEN gone THEN 'REDACTED' ELSE abha_id END AS abha_id,
        CASE WHEN gone THEN 'PURGED' END AS consent_token
        FROM (SELECT *, evaluation = 'PURGED' AS gone FROM erased) t""",
)
def m10(spark, sf):
    out = d.wipe_purged(d.apply_erasure_policy(fixture(spark, sf, "intake"), AS_OF))
    return out.select(
        "notice_id", "outcome", "clinical_payload", "patient_name", "abha_id", "consent_token"
    )


@query(
    "M10_wipe_audit_rows",
    ERASED
    + f"""SELECT {q.token('abha_id')} AS target_token, erasure_reason AS compliance_rule,
        CAST(count(*) AS BIGINT) AS n FROM erased WHERE evaluation = 'PURGED'
        GROUP BY ALL""",
)
def m10_audit(spark, sf):
    out = d.apply_erasure_policy(fixture(spark, sf, "intake"), AS_OF)
    events = tb.audit_events(
        out.filter(c("evaluation") == "PURGED"),
        AS_OF,
        F.lit("RULE_8_PURGE"),
        p.id_token(c("abha_id")),
        c("erasure_reason"),
        F.lit("Hard purge"),
    )
    return events.groupBy("target_token", "compliance_rule").agg(F.count("*").alias("n"))


@query(
    "M11_identity_desk_view",
    GATED
    + f"""SELECT notice_id, abha_id, {q.mask_name('patient_name')} AS patient_name FROM gated
        WHERE status_reason = 'MISSING_ABHA'""",
)
def m11_identity(spark, sf):
    return d.desk_view(d.apply_gate(fixture(spark, sf, "intake")), "IDENTITY")


@query(
    "M11_clinical_desk_view",
    GATED
    + f"""SELECT notice_id, clinical_payload, {q.mask_name('patient_name')} AS patient_name, bill_amount
        FROM gated WHERE status_reason = 'PENDING_CLINICAL_AUDIT'""",
)
def m11_clinical(spark, sf):
    return d.desk_view(d.apply_gate(fixture(spark, sf, "intake")), "CLINICAL")

"""Rules once more, as plain SQL: the common expressions of the SQL twins."""

from __future__ import annotations

from wardgate.functions import vocab as v

AS_OF = "TIMESTAMP '1998-07-01 12:00:00'"
CUTOFF = f"({AS_OF} - INTERVAL 365 DAY)"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


GATED = f"""
SELECT *, CASE WHEN status_reason = 'PENDING_CLINICAL_AUDIT' OR NOT abha_valid THEN 'QUARANTINED'
    WHEN coalesce(consent_status = 'REVOKED', false) THEN 'PURGED' ELSE 'PROCESSED' END
    AS ingest_status
FROM (
  SELECT *, CASE WHEN bill_amount > 5000 AND NOT surgical_truth THEN 'PENDING_CLINICAL_AUDIT'
      WHEN consent_status = 'REVOKED' THEN 'CONSENT_REVOKED'
      WHEN NOT abha_valid THEN 'MISSING_ABHA' ELSE 'N/A' END AS status_reason
  FROM (
    SELECT * REPLACE (fixed AS abha_id) EXCLUDE (fixed, digits),
      regexp_matches(fixed, {lit(v.ID_HYPHENATED)}) AS abha_valid,
      coalesce(length(clinical_payload) >= 20
        AND NOT regexp_matches(clinical_payload, {lit('(?i)' + v.NO_EVIDENCE_ALTERNATIVES)})
        AND regexp_matches(clinical_payload, {lit('(?i)(' + '|'.join(v.EVIDENCE_TERMS) + ')')}), false) AS surgical_truth
    FROM (
      SELECT *, CASE WHEN regexp_matches(digits, '^[0-9]{{14}}$')
          THEN regexp_replace(digits, '^(..)(....)(....)(....)$', '\\1-\\2-\\3-\\4')
          ELSE coalesce(abha_id, '') END AS fixed
      FROM (SELECT *, replace(coalesce(abha_id, ''), '-', '') AS digits FROM {{source}}) a) b) c) d
""".replace("* REPLACE (fixed AS abha_id) EXCLUDE (fixed, digits)", "* EXCLUDE (fixed, digits) REPLACE (fixed AS abha_id)")


def gated(source: str = "intake") -> str:
    return GATED.replace("{source}", source)


STORED_COLUMNS = """notice_id, abha_id, patient_name, notice_date, consent_status, clinical_payload,
    bill_amount, surgical_truth, ingest_status, status_reason"""

REASON = f"""CASE WHEN upper(consent_status) = 'REVOKED' THEN 'CONSENT_REVOKED'
    WHEN CAST(notice_date AS TIMESTAMP) < {CUTOFF} THEN 'NOTICE_EXPIRED'
    WHEN data_purpose NOT IN ('Consultation', 'Treatment', 'Audit', 'Emergency Care')
    THEN 'UNAUTHORIZED_PURPOSE' ELSE 'N/A' END"""

OUTCOME = """CASE WHEN erasure_reason <> 'N/A' THEN 'PURGED_' || erasure_reason
    WHEN consent_status IN ('ACTIVE', 'GRANTED') THEN 'SUCCESS_LINKED'
    ELSE 'QUARANTINED_PENDING' END"""

ERASED = f"""SELECT *, {OUTCOME} AS outcome,
    CASE WHEN erasure_reason = 'N/A' THEN 'PROCESSED' ELSE 'PURGED' END AS evaluation
    FROM (SELECT *, {REASON} AS erasure_reason FROM intake) t"""


def token(expr: str) -> str:
    return (
        f"CASE WHEN {expr} IS NULL OR {expr} IN ('', 'REDACTED', 'UNKNOWN', 'None') THEN '****' "
        f"ELSE substr(sha256({expr}), 1, 8) || '****' END"
    )


def blank(expr: str) -> str:
    return f"coalesce(trim({expr}) = '', true)"


def mask_name(expr: str) -> str:
    return f"""CASE WHEN {blank(expr)} OR {expr} IN ('None', 'Unknown/Redacted')
        THEN '[MISSING/REDACTED]' WHEN starts_with({expr}, 'Patient_')
        THEN 'P********_' || substr({expr}, 9) WHEN length({expr}) < 4 THEN '****'
        ELSE left({expr}, 1) || repeat('*', CAST(length({expr}) - 2 AS INT)) || right({expr}, 1) END"""


def mask_id(expr: str) -> str:
    packed = f"replace({expr}, ' ', '')"
    return f"""CASE WHEN {blank(expr)} OR {expr} = 'None' THEN '[MISSING_ABHA]'
        WHEN regexp_matches({packed}, '^[0-9]{{14}}$')
        THEN left({packed}, 2) || ' XXXX XXXX ' || right({packed}, 4)
        WHEN length({packed}) > 4 THEN left({packed}, 2) || ' XXXX ' || right({packed}, 2)
        ELSE '****' END"""


def mask_payload(expr: str) -> str:
    return f"CASE WHEN {blank(expr)} THEN '[EMPTY_PAYLOAD]' ELSE {lit(v.PROTECTED_PAYLOAD)} END"


def redact(expr: str) -> str:
    for label, pattern in v.REDACTIONS.items():
        expr = f"regexp_replace({expr}, {lit(pattern)}, '[REDACTED_{label}]', 'g')"
    return expr


def first_match(expr: str, patterns: tuple[str, ...]) -> str:
    return (
        "coalesce("
        + ", ".join(f"nullif(regexp_extract({expr}, {lit(p)}, 1), '')" for p in patterns)
        + ", NULL)"
    )


def strip(expr: str) -> str:
    return f"trim({expr}, ' ' || chr(9) || chr(10) || chr(13))"


def member(payload: str, key: str, default: str) -> str:
    """Member of a JSON object, or the default."""
    clean = f"replace({payload}, '''', '\"')"
    ok = f"json_valid({clean}) AND json_type({clean}) = 'OBJECT'"
    return (
        f"CASE WHEN {ok} AND json_exists({clean}, '$.{key}') "
        f"THEN json_extract_string({clean}, '$.{key}') ELSE '{default}' END"
    )


def snomed(expr: str, default: str) -> str:
    whens = " ".join(f"WHEN {lit(k)} THEN {lit(c)}" for k, c in v.SNOMED.items())
    return f"CASE {expr} {whens} ELSE {lit(default)} END"

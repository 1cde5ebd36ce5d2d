"""Inputs of the registered queries, derived from the given tables.

Each is one SQL text that Spark and DuckDB both run, so query and twin see the same rows.  Keys:
k = o_orderkey, u = o_custkey.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("orders", "customer", "part")


def _padded(expr: str) -> str:
    return f"lpad(CAST(({expr}) % 10000 AS STRING), 4, '0')"


def _health_id(u: str, glue: str) -> str:
    parts = [f"CAST(10 + {u} % 90 AS STRING)", _padded(u), _padded(f"7 * {u}"), _padded(f"13 * {u}")]
    return f" || '{glue}' || ".join(parts)


def _person(u: str) -> str:
    return f"'Patient_' || CAST({u} AS STRING) || '_' || CAST(1000 + {u} % 9000 AS STRING)"


def _quoted(expr: str) -> str:
    """A JSON string or null."""
    return (
        "coalesce('\"' || replace(" + expr + ", '\"', chr(92) || '\"') || '\"', 'null')"
    )


DIAGNOSIS = """CASE o_orderpriority WHEN '1-URGENT' THEN 'Hypertension' WHEN '2-HIGH' THEN 'Migraine'
    WHEN '3-MEDIUM' THEN 'Viral Fever' WHEN '5-LOW' THEN 'Asthma' ELSE 'Condition_9' END"""
VISIT = "CASE o_orderstatus WHEN 'F' THEN 'OPD' WHEN 'O' THEN 'IPD' ELSE 'EMERGENCY' END"

FIELDS = """patient_name, abha_id, clinical_payload, bill_amount, consent_status, notice_id,
    notice_date, data_purpose"""

SQL: dict[str, str] = {}

SQL["base"] = f"""
SELECT o_orderkey AS k, o_custkey AS u, {DIAGNOSIS} AS diag,
    {_person('o_custkey')} AS patient_name,
    CASE WHEN o_orderkey % 20 = 0 THEN NULL
        WHEN o_orderkey % 20 = 1 THEN 'ABHA-' || CAST(100 + o_orderkey % 900 AS STRING)
        WHEN o_orderkey % 20 = 2 THEN {_health_id('o_custkey', '')}
        ELSE {_health_id('o_custkey', '-')} END AS abha_id,
    CASE WHEN o_orderkey % 10 = 3 THEN 'XYZ-LOG: No clinical notes available, unknown condition.'
        WHEN o_orderkey % 10 = 4 THEN 'Standard clinical examination.'
        WHEN o_orderkey % 50 = 7 THEN 'fever'
        WHEN o_orderkey % 50 = 17 THEN NULL
        ELSE '{{"diagnosis": "' || {DIAGNOSIS} || '", "treatment": "Prescribed rest", "visit_type": "'
            || {VISIT} || '"}}' END AS clinical_payload,
    CAST(floor(o_totalprice / 50) AS DOUBLE) AS bill_amount,
    CASE WHEN o_orderkey % 97 = 0 THEN NULL
        WHEN o_orderkey % 10 = 5 OR o_orderkey % 40 = 0 OR o_orderkey % 60 = 3 THEN 'REVOKED'
        WHEN o_orderkey % 13 = 0 THEN 'PENDING'
        WHEN o_orderstatus = 'F' THEN 'GRANTED' ELSE 'ACTIVE' END AS consent_status,
    'N-' || CASE WHEN o_orderkey % 20 = 9 THEN '2025' ELSE '2026' END || '-CONS-v1.'
        || CAST(o_orderkey % 10 AS STRING) || '-' || CAST(o_orderkey AS STRING) AS notice_id,
    CAST(CAST(o_orderdate AS DATE) AS STRING) AS notice_date,
    CASE o_orderkey % 6 WHEN 0 THEN 'Consultation' WHEN 1 THEN 'Treatment' WHEN 2 THEN 'Audit'
        WHEN 3 THEN 'Emergency Care' WHEN 4 THEN 'Marketing' END AS data_purpose
FROM orders
"""

SQL["intake"] = f"SELECT {FIELDS} FROM base"

SQL["batch2"] = f"""
SELECT patient_name, abha_id, clinical_payload, bill_amount, 'REVOKED' AS consent_status, notice_id,
    notice_date, data_purpose, CAST(1 AS BIGINT) AS arrival_seq FROM base WHERE k % 7 = 0
UNION ALL
SELECT patient_name, abha_id, clinical_payload, bill_amount + 100, 'REVOKED', notice_id, notice_date,
    data_purpose, CAST(2 AS BIGINT) FROM base WHERE k % 70 = 0
UNION ALL
SELECT patient_name, abha_id, clinical_payload, bill_amount, consent_status,
    'N-2026-CONS-v1.' || CAST(k % 10 AS STRING) || '-' || CAST(k + 10000000 AS STRING), notice_date,
    data_purpose, CAST(1 AS BIGINT) FROM base WHERE k % 11 = 0
"""

SQL["corrections"] = f"""
SELECT notice_id,
    CASE WHEN k % 20 IN (0, 1) AND k % 3 <> 0 AND k % 8 <> 0 THEN {_health_id('u', '-')}
        ELSE abha_id END AS abha_id,
    CASE WHEN k % 10 = 3 AND k % 4 = 1 AND k % 8 <> 0
        THEN 'Patient diagnosed with asthma; prescribed salbutamol.'
        ELSE clinical_payload END AS clinical_payload,
    bill_amount
FROM base
WHERE (k % 20 IN (0, 1) AND k % 3 <> 0) OR (k % 10 = 3 AND k % 4 = 1) OR (k % 8 = 0)
"""

SQL["registry"] = f"""
SELECT {_person('c_custkey')} AS patient_name, {_health_id('c_custkey', '-')} AS abha_id,
    CASE c_custkey % 3 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'GRANTED' ELSE 'REVOKED' END
        AS consent_status, CAST(1 AS BIGINT) AS reg_seq
FROM customer WHERE c_custkey % 5 <> 0
UNION ALL
SELECT {_person('c_custkey')}, {_health_id('c_custkey', '-')}, 'PENDING', CAST(2 AS BIGINT)
FROM customer WHERE c_custkey % 50 = 1
"""

SQL["links"] = f"""
SELECT {_person('c_custkey')} AS patient_name, 'ABHA' || lpad(CAST(c_custkey % 1000000 AS STRING), 6,
    '0') AS abha_id FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 2 = 0
"""

SQL["reports"] = """
SELECT k AS doc_id,
    CASE WHEN k % 11 = 0 THEN 'Ward round.' || chr(10) || 'Mr. Asha Verma seen today.'
        WHEN k % 3 = 0 THEN 'Pt. Name: ' || patient_name
        WHEN k % 7 = 0 THEN 'Full Name: Asha Rani Verma' ELSE 'Patient Name: ' || patient_name END
    || chr(10) || CASE WHEN k % 4 = 0 THEN 'Health ID: ' ELSE 'ABHA ID: ' END
    || CASE WHEN k % 13 = 0 THEN 'asha.' || CAST(k AS STRING) || '@sbx'
        WHEN k % 17 = 0 THEN replace(coalesce(abha_id, 'None'), '-', ' ')
        ELSE coalesce(abha_id, 'None') END
    || chr(10) || CASE WHEN k % 12 = 0 THEN 'Ref No: R-' || CAST(k AS STRING)
        ELSE 'Notice ID: ' || notice_id END
    || chr(10) || 'Notice Date: ' || CASE WHEN k % 5 = 0
        THEN substring(notice_date, 9, 2) || '-' || substring(notice_date, 6, 2) || '-'
            || substring(notice_date, 1, 4)
        WHEN k % 5 = 1 THEN replace(notice_date, '-', '/') ELSE notice_date END
    || chr(10) || CASE WHEN k % 9 = 0 THEN 'Seen by staff'
        ELSE 'Consent Status: ' || coalesce(consent_status, 'pending') END
    || chr(10) || 'Clinical Payload: ' || coalesce(clinical_payload, 'None')
    || CASE WHEN k % 6 = 0 THEN chr(10) || 'Impression: ' || diag || ', stable' ELSE '' END
    || CASE WHEN k % 29 = 0 THEN repeat(chr(10) || 'Seen again on the ward.', 120) ELSE '' END
    AS body
FROM base
"""

SQL["json_lines"] = f"""
SELECT k AS doc_id, substring(body, 1, CASE WHEN k % 31 = 0 THEN 40 ELSE 1000000 END) AS body FROM (
SELECT k, '{{"patient_name": ' || {_quoted('patient_name')} || ', "abha_id": ' || {_quoted('abha_id')}
    || ', "clinical_payload": ' || {_quoted('clinical_payload')} || ', "bill_amount": '
    || CAST(CAST(bill_amount AS BIGINT) AS STRING) || ', "consent_status": '
    || {_quoted('consent_status')} || ', "notice_id": ' || {_quoted('notice_id')}
    || ', "notice_date": ' || {_quoted('notice_date')} || ', "data_purpose": '
    || {_quoted('data_purpose')} || '}}' AS body FROM base) t
"""

_ITEM = f"""'{{"Pt Name": ' || {_quoted('patient_name')} || ', "health-id": ' || {_quoted('abha_id')}
    || ', "Clinical_Notes": ' || {_quoted('clinical_payload')} || ', "ward": "W1", "consent": '
    || {_quoted('consent_status')} || ', "REFERENCE NO": ' || {_quoted('notice_id')}
    || ', "issue date": ' || {_quoted('notice_date')} || '}}'"""

SQL["api_docs"] = f"""
SELECT k AS doc_id, substring(CASE k % 6 WHEN 0 THEN '{{"status": "ok", "data": ['
        WHEN 1 THEN '{{"results": [' WHEN 2 THEN '{{"items": '
        WHEN 3 THEN '{{"page": 1, "patients": [' WHEN 4 THEN '[' ELSE '' END
    || item || CASE WHEN k % 6 = 1 THEN ', ' || item ELSE '' END
    || CASE k % 6 WHEN 2 THEN '}}' WHEN 4 THEN ']' WHEN 5 THEN '' ELSE ']}}' END,
    1, CASE WHEN k % 31 = 0 THEN 60 ELSE 1000000 END) AS body
FROM (SELECT k, {_ITEM} AS item FROM base) t
"""

SQL["manifest"] = """
SELECT 'drop/' || CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN 'raw_data_csv/' WHEN 2 THEN 'raw_data_hl7/'
        WHEN 3 THEN 'raw_data_txt/' ELSE 'elsewhere/' END
    || CASE WHEN k % 41 = 1 THEN 'standardized_ingress_1000' ELSE 'file.' || CAST(k AS STRING) END
    || CASE k % 14 WHEN 0 THEN '.csv' WHEN 1 THEN '.JSON' WHEN 2 THEN '.xml' WHEN 3 THEN '.xlsx'
        WHEN 4 THEN '.dcm' WHEN 5 THEN '.hl7' WHEN 6 THEN '.fhir' WHEN 7 THEN '.pdf'
        WHEN 8 THEN '.txt' WHEN 9 THEN '.report' WHEN 10 THEN '.bin' WHEN 11 THEN '.xls'
        WHEN 12 THEN '.hl7v2' ELSE '' END AS path,
    CAST(1000 + k % 977 AS BIGINT) AS n_bytes
FROM base
"""

SQL["headers"] = """
SELECT p_brand AS source_id, CAST(p_partkey AS BIGINT) AS position,
    CASE WHEN p_partkey % 17 = 0 THEN ' ' || name || ' ' ELSE name END AS column_name
FROM (SELECT p_brand, p_partkey, CASE WHEN p_partkey % 23 = 0 THEN p_name ELSE
    CASE p_partkey % 13 WHEN 0 THEN 'Patient' WHEN 1 THEN 'Pt' WHEN 2 THEN 'Health'
        WHEN 3 THEN 'ABHA' WHEN 4 THEN 'notice' WHEN 5 THEN 'Consent' WHEN 6 THEN 'Clinical'
        WHEN 7 THEN 'member' WHEN 8 THEN 'dpdp_notice' WHEN 9 THEN 'visit' WHEN 10 THEN 'Ref'
        WHEN 11 THEN 'patient_full' ELSE 'Doc' END
    || CASE floor(p_partkey / 143) % 4 WHEN 0 THEN '_' WHEN 1 THEN ' ' WHEN 2 THEN '-' ELSE '' END
    || CASE floor(p_partkey / 13) % 11 WHEN 0 THEN 'Name' WHEN 1 THEN 'ID' WHEN 2 THEN 'no'
        WHEN 3 THEN 'Date' WHEN 4 THEN 'status' WHEN 5 THEN 'data' WHEN 6 THEN 'Information'
        WHEN 7 THEN 'timestamp' WHEN 8 THEN 'code' WHEN 9 THEN 'flag' ELSE 'colour' END
    END AS name FROM part) t
"""

NEEDS = {
    "base": (),
    "intake": ("base",),
    "batch2": ("base",),
    "corrections": ("base",),
    "registry": (),
    "links": (),
    "reports": ("base",),
    "json_lines": ("base",),
    "api_docs": ("base",),
    "manifest": ("base",),
    "headers": (),
}


def _ordered(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for n in names:
        out += [x for x in (*_ordered(NEEDS[n]), n) if x not in out]
    return out


def with_fixtures(*names: str, **extra: str) -> str:
    """``WITH`` clause that defines the fixtures, then the further expressions in order."""
    parts = [f"{n} AS ({SQL[n]})" for n in _ordered(names)]
    parts += [f"{n} AS ({s})" for n, s in extra.items()]
    return "WITH " + ",\n".join(parts) + "\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input, as a projection of the given tables inside the query's own plan."""
    for t in TABLES:
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(with_fixtures(name) + f"SELECT * FROM {name}")

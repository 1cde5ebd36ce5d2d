"""Queries over scorecards and top-k reports, and the flagship intake scorecard."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardgate.operators import dispositions as d
from wardgate.operators import metrics as m
from wardgate.operators import naming
from wardgate.plans import sql_rules as q
from wardgate.plans.fixtures import fixture, with_fixtures
from wardgate.plans.registry import AS_OF, query

c = F.col
INTAKE = with_fixtures("intake")
GATED = with_fixtures("intake", gated=q.gated())
ERASED = with_fixtures("intake", erased=q.ERASED)
N = "CAST(count(*) AS BIGINT)"


def _gated(spark, sf):
    return d.apply_gate(naming.canonical_rename(fixture(spark, sf, "intake")))


def _count_if(cond: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {cond}) AS BIGINT)"


@query(
    "intake_scorecard",
    GATED
    + f"""SELECT ingest_status, status_reason, {N} AS n,
        CAST(sum(CAST(bill_amount AS DECIMAL(18, 2))) AS DOUBLE) AS bill_total
        FROM gated GROUP BY ALL""",
)
def intake_scorecard(spark, sf):
    card = m.disposition_summary(_gated(spark, sf))
    return card.withColumn("bill_total", c("bill_total").cast("double"))


CARD = f"""SELECT {N} AS total, {_count_if("ingest_status = 'PROCESSED'")} AS processed,
    {_count_if("ingest_status = 'PURGED'")} AS purged,
    {_count_if("ingest_status = 'QUARANTINED'")} AS quarantined FROM gated"""


@query("A1_scorecard", GATED + CARD)
def a1(spark, sf):
    return m.scorecard(_gated(spark, sf))


@query(
    "A2_reason_histogram",
    GATED
    + f"""SELECT ingest_status, status_reason, {N} AS n FROM gated
        WHERE ingest_status <> 'PROCESSED' GROUP BY ALL""",
)
def a2(spark, sf):
    return m.reasons(_gated(spark, sf))


@query(
    "A3_status_shares",
    GATED
    + f"""SELECT 100.0::DOUBLE * processed / total AS processed_pct,
        100.0::DOUBLE * purged / total AS purged_pct,
        100.0::DOUBLE * quarantined / total AS quarantined_pct FROM ({CARD}) x""",
)
def a3(spark, sf):
    return m.shares(_gated(spark, sf))


@query(
    "A4_revenue_on_hold",
    GATED
    + f"""SELECT {N} AS held, CAST(sum(CAST(bill_amount AS DECIMAL(18, 2))) AS DOUBLE)
        AS hold_amount FROM gated WHERE status_reason = 'PENDING_CLINICAL_AUDIT'""",
)
def a4(spark, sf):
    held = m.revenue_on_hold(_gated(spark, sf))
    return held.withColumn("hold_amount", c("hold_amount").cast("double"))


@query(
    "A5_flow_telemetry",
    GATED
    + f"""SELECT {N} AS intake, {_count_if("ingest_status = 'PROCESSED'")} AS cleared,
        {_count_if("ingest_status <> 'PROCESSED'")} AS not_cleared FROM gated""",
)
def a5(spark, sf):
    return m.flow(_gated(spark, sf))


@query(
    "A6_outcome_summary",
    ERASED
    + f"""SELECT CASE WHEN contains(outcome, 'SUCCESS') THEN 'Linked'
        WHEN contains(outcome, 'PURGED') THEN 'Purged' ELSE 'Quarantined' END AS label, {N} AS n
        FROM erased GROUP BY ALL""",
)
def a6(spark, sf):
    return m.outcome_summary(m.linked_outcomes(fixture(spark, sf, "intake"), AS_OF))


# Payloads that also name a medication and a lab test.
RICH = """CASE WHEN k % 3 = 0 THEN replace(clinical_payload, '}', ', "medication": "'
        || CASE k % 4 WHEN 0 THEN 'None' WHEN 1 THEN 'Metformin 500mg' WHEN 2 THEN 'Insulin'
            ELSE '' END || '", "lab_test": "' || CASE k % 5 WHEN 0 THEN 'HbA1c' WHEN 1 THEN 'None'
            ELSE 'CBC' END || '"}')
    WHEN k % 10 = 4 THEN 'Standard IPD examination.' ELSE clinical_payload END"""

_J = "CASE WHEN json_valid(p) AND json_type(p) = 'OBJECT' THEN json_extract_string(p, '$.{0}') END"
CATEGORIES = f"""
SELECT category, item, {N} AS n FROM (
    SELECT 'VISIT TYPE' AS category, CASE WHEN vt <> 'UNKNOWN' THEN vt
        WHEN contains(p, 'OPD') THEN 'OPD' WHEN contains(p, 'IPD') THEN 'IPD'
        WHEN contains(p, 'EMERGENCY') THEN 'EMERGENCY' WHEN contains(p, 'TELECONSULT')
        THEN 'TELECONSULT' ELSE 'UNKNOWN' END AS item
    FROM (SELECT p, coalesce({_J.format('visit_type')}, 'UNKNOWN') AS vt FROM rich) t
    UNION ALL SELECT 'DIAGNOSIS', nullif({_J.format('diagnosis')}, '') FROM rich
    UNION ALL SELECT 'MEDICATION', nullif(nullif({_J.format('medication')}, ''), 'None') FROM rich
    UNION ALL SELECT 'LAB TESTS', nullif(nullif({_J.format('lab_test')}, ''), 'None') FROM rich
) x WHERE item IS NOT NULL GROUP BY ALL"""
RICHLY = with_fixtures("base", rich=f"SELECT {RICH} AS p FROM base")


def _rich(spark, sf):
    return fixture(spark, sf, "base").select(F.expr(RICH).alias("clinical_payload"))


@query("A7_category_frequency", RICHLY + CATEGORIES)
def a7(spark, sf):
    return m.category_counts(_rich(spark, sf))


@query(
    "W3_top_items",
    RICHLY
    + f"""SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY n DESC, item) AS INT) AS rank
        FROM ({CATEGORIES}) c QUALIFY rank <= 5""",
)
def w3(spark, sf):
    return m.top_items(m.category_counts(_rich(spark, sf)))


@query(
    "W3_bounded_top_items",
    RICHLY
    + f"""SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY n DESC, item) AS INT) AS rank
        FROM ({CATEGORIES}) c QUALIFY rank <= 5""",
)
def w3_bounded(spark, sf):
    """The same from bounded sketches and an exact second count of what they name."""
    return m.bounded_top_items(m.category_items(_rich(spark, sf)))


@query(
    "A8_compliance_stats",
    INTAKE
    + f"""SELECT *, 100.0::DOUBLE * null_ids / total AS null_ids_pct,
        100.0::DOUBLE * revoked / total AS revoked_pct, 100.0::DOUBLE * expired / total AS expired_pct
        FROM (SELECT {N} AS total, {_count_if('abha_id IS NULL')} AS null_ids,
            {_count_if("consent_status = 'REVOKED'")} AS revoked,
            {_count_if(f"CAST(notice_date AS TIMESTAMP) < {q.AS_OF} - INTERVAL 30 DAY")} AS expired
            FROM intake) t""",
)
def a8(spark, sf):
    return m.compliance_stats(fixture(spark, sf, "intake"), AS_OF)


# A third of all rows come from one file of one format.
LANDED = """SELECT CASE WHEN k % 3 = 0 THEN 'CSV' ELSE CASE k % 5 WHEN 0 THEN 'JSON' WHEN 1 THEN 'XML'
        WHEN 2 THEN 'HL7' ELSE 'CSV' END END AS format,
    CASE WHEN k % 3 = 0 THEN 'big.csv' ELSE 'part-' || CAST(k % 97 AS STRING) END AS file FROM base"""


@query(
    "A9_format_summary",
    with_fixtures("base", landed=LANDED)
    + f"""SELECT format, CAST(count(DISTINCT file) AS BIGINT) AS files, {N} AS rows FROM landed
        GROUP BY format""",
)
def a9(spark, sf):
    fixture(spark, sf, "base").createOrReplaceTempView("base")
    return m.format_summary(spark.sql(LANDED))


@query(
    "A10_scorecard_rows",
    GATED
    + f"""SELECT CASE ingest_status WHEN 'PROCESSED' THEN 'Success' WHEN 'PURGED' THEN 'Purged'
        ELSE 'Quarantined' END AS status, {N} AS count FROM gated GROUP BY ALL""",
)
def a10(spark, sf):
    return m.scorecard_rows(_gated(spark, sf))

"""Hand-made edge rows for the rules, where the policies differ or null decides."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wardgate.functions import payload as pl
from wardgate.functions import rules as r
from wardgate.operators import dispositions as d
from wardgate.operators import metrics as m
from wardgate.operators.naming import canonical_rename

AS_OF = datetime(2026, 7, 1, 12, 0, 0)
c = F.col


def values(spark, expr, *texts):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    return [row[0] for row in df.orderBy("i").select(expr(c("x"))).collect()]


def test_id_normalization(spark):
    assert values(
        spark, r.normalized_id, "12345678901234", "12-3456-7890-1234", "1234-5678-9012-34", None, "ABHA-123",
        "12 3456 7890 1234", "12345678901234\n",
    ) == [
        "12-3456-7890-1234", "12-3456-7890-1234", "12-3456-7890-1234", "", "ABHA-123",
        "12 3456 7890 1234", "12345678901234\n",
    ]


def test_valid_means_hyphenated_after_normalising(spark):
    texts = ["12345678901234", "12-3456-7890-1234", "-12345678901234-", "", None, "1234567890123x", "123"]
    direct = values(spark, r.id_is_valid, *texts)
    staged = values(spark, lambda x: r.id_is_hyphenated(r.normalized_id(x)), *texts)
    assert direct == staged == [True, True, True, False, False, False, False]


def test_id_v1(spark):
    assert values(spark, r.id_is_accepted_v1, "a.b@sbx", "12-3456-7890-1234", "12345678901234", None) == [
        True, True, False, False,
    ]


@pytest.mark.parametrize(
    "payload,expected",
    [
        ("Patient was diagnosed with asthma today", True),
        ("fever", False),  # too short
        ("Standard clinical examination.", False),  # no term
        ("No treatment notes. Fever reported twice.", False),  # denied
        ("no   RECORDS of the fever were kept", False),
        ("HYPERTENSION confirmed at visit", True),
        ("Fever; labs n/a for this visit now", False),
        ("manila paper: patient has a fever", False),  # 'nil' inside a word counts, as in the rule
        (None, False),
    ],
)
def test_evidence(spark, payload, expected):
    assert values(spark, lambda x: r.has_clinical_evidence("x"), payload) == [expected]


def gated(spark, **fields):
    base = {
        "patient_name": "P", "abha_id": "12-3456-7890-1234", "clinical_payload": None,
        "bill_amount": "100", "consent_status": "ACTIVE", "notice_id": "N-2026-A-1",
        "notice_date": "2026-06-01", "data_purpose": None,
    } | fields
    df = spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} string" for k in base))
    row = d.apply_gate(canonical_rename(df)).first()
    return row["ingest_status"], row["status_reason"]


def test_gate_status_and_reason_order_differ(spark):
    assert gated(spark, abha_id="bad", consent_status="REVOKED") == ("QUARANTINED", "CONSENT_REVOKED")
    assert gated(spark, abha_id=None) == ("QUARANTINED", "MISSING_ABHA")
    assert gated(spark, consent_status="REVOKED") == ("PURGED", "CONSENT_REVOKED")
    assert gated(spark, consent_status="revoked") == ("PROCESSED", "N/A")
    assert gated(spark, consent_status=None) == ("PROCESSED", "N/A")


def test_gate_holds_high_bills_without_evidence(spark):
    assert gated(spark, bill_amount="5000.01") == ("QUARANTINED", "PENDING_CLINICAL_AUDIT")
    assert gated(spark, bill_amount="5000") == ("PROCESSED", "N/A")
    assert gated(spark, bill_amount="9000", clinical_payload="Prescribed insulin for diabetes") == (
        "PROCESSED", "N/A",
    )
    assert gated(spark, bill_amount="9000", consent_status="REVOKED", abha_id="x") == (
        "QUARANTINED", "PENDING_CLINICAL_AUDIT",
    )
    assert gated(spark, bill_amount="many") == ("PROCESSED", "N/A")


def v1(spark, **fields):
    base = {
        "abha_id": "12-3456-7890-1234", "consent_status": "ACTIVE", "notice_id": "N-2026-A",
        "notice_date": "2026-06-01",
    } | fields
    df = spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} string" for k in base))
    row = d.apply_intake_v1(df, AS_OF).first()
    return row["ingest_status"], row["status_reason"]


def test_intake_v1(spark):
    assert v1(spark) == ("PROCESSED", "N/A")
    assert v1(spark, notice_date="2025-07-01") == ("PURGED", "NOTICE_EXPIRED")  # midnight, 365 days back
    assert v1(spark, notice_date="2025-07-02") == ("PROCESSED", "N/A")
    assert v1(spark, notice_date="01/02/2020") == ("PROCESSED", "N/A")  # unreadable: given today
    assert v1(spark, notice_id="N-2025-X") == ("PURGED", "N/A")
    assert v1(spark, notice_id=None) == ("PROCESSED", "N/A")
    assert v1(spark, abha_id="") == ("QUARANTINED", "MISSING_ABHA")
    assert v1(spark, abha_id="x y") == ("QUARANTINED", "MALFORMED_ID")


def erasure(spark, consent, date, purpose):
    df = spark.createDataFrame(
        [(consent, date, purpose)], "consent_status string, notice_date string, data_purpose string"
    )
    return d.apply_erasure_policy(df, AS_OF).first()["outcome"]


def test_erasure_policy(spark):
    assert erasure(spark, "revoked", "2026-06-01", "Audit") == "PURGED_CONSENT_REVOKED"
    assert erasure(spark, "ACTIVE", "2024-01-01", "Marketing") == "PURGED_NOTICE_EXPIRED"
    assert erasure(spark, "ACTIVE", "13/01/2024", "Audit") == "PURGED_NOTICE_EXPIRED"
    assert erasure(spark, "ACTIVE", "nonsense", "Marketing") == "PURGED_UNAUTHORIZED_PURPOSE"
    assert erasure(spark, "ACTIVE", None, None) == "SUCCESS_LINKED"
    assert erasure(spark, "PENDING", "2026-06-01", "") == "QUARANTINED_PENDING"
    assert erasure(spark, None, "2026-06-01", "Audit") == "QUARANTINED_PENDING"


def test_lenient_dates_prefer_month_first(spark):
    got = values(spark, r.lenient_timestamp, "05-06-2020", "25-06-2020", "2020-05-06T07:08:09", "12:30", "x")
    assert got == [
        datetime(2020, 5, 6), datetime(2020, 6, 25), datetime(2020, 5, 6, 7, 8, 9), None, None,
    ]


def test_payload_members(spark):
    def pair(x):
        o = pl.payload_object(x)
        return F.concat_ws("/", pl.diagnosis(o), pl.visit_type(o))

    assert values(
        spark, pair, "{'diagnosis': 'Flu'}", '{"visit_type": "OPD"}', '{"diagnosis": "x', "[1]", None,
        '{"diagnosis": "a"} trailing',
    ) == ["Flu/UNKNOWN", "/OPD", "/UNKNOWN", "/UNKNOWN", "/UNKNOWN", "/UNKNOWN"]


def test_final_validated_drops_unknown_reason(spark):
    df = spark.createDataFrame([("a", "N/A"), ("b", "CONSENT_REVOKED"), ("c", None)], "k string, status_reason string")
    assert [x["k"] for x in d.final_validated(df).collect()] == ["a"]


def test_statuses_partition_the_batch(spark):
    df = spark.createDataFrame([], "ingest_status string, status_reason string, bill_amount double")
    assert m.scorecard(df).first().asDict() == {
        "total": 0, "processed": 0, "purged": 0, "quarantined": 0,
    }
    assert m.shares(df).first()["purged_pct"] == 0.0

import hashlib

from pyspark.sql import functions as F

from wardgate.functions import privacy as p
from wardgate.operators import dispositions as d

c = F.col


def values(spark, expr, *texts):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    return [row[0] for row in df.orderBy("i").select(expr(c("x"))).collect()]


def test_id_token(spark):
    h = hashlib.sha256(b"12-34").hexdigest()[:8] + "****"
    assert values(spark, p.id_token, "12-34", "", None, "REDACTED", "UNKNOWN", "None") == [h] + ["****"] * 5


def test_pseudonym_keeps_redacted(spark):
    got = values(spark, lambda x: p.pseudonym(x, "Pt_"), "Asha", "REDACTED", None, "")
    assert got[0].startswith("Pt_") and got[1:] == ["REDACTED", None, ""]


def test_mask_short(spark):
    assert values(spark, p.mask_short, "abc", "abcd", "abcdef", " ", None, "None") == [
        "****", "a****", "ab****ef", "[MISSING/REDACTED]", "[MISSING/REDACTED]", "[MISSING/REDACTED]",
    ]


def test_mask_name(spark):
    assert values(spark, p.mask_name, "Patient_7_1234", "Asha", "Al", "Unknown/Redacted", None, "Patient_") == [
        "P********_7_1234", "A**a", "****", "[MISSING/REDACTED]", "[MISSING/REDACTED]", "P********_",
    ]


def test_mask_id(spark):
    assert values(spark, p.mask_id, "12345678901234", "12-3456-7890-1234", "1234", None, "12 345 678901234") == [
        "12 XXXX XXXX 1234", "12 XXXX 34", "****", "[MISSING_ABHA]", "12 XXXX XXXX 1234",
    ]


def test_redaction(spark):
    text = "mail a.b@c.org id 12-3456-7890-1234 tel +919876543210 no 1234 5678 9012 end"
    assert values(spark, p.redact_text, text, None, "nothing") == [
        "mail [REDACTED_EMAIL] id [REDACTED_ABHA] tel +[REDACTED_PHONE] no [REDACTED_AADHAAR] end",
        None,
        "nothing",
    ]


def test_no_raw_identity_in_masked_or_wiped_output(spark):
    df = spark.createDataFrame(
        [("Asha Verma", "12-3456-7890-1234", "{}", "REVOKED", "2026-01-01", "Audit")],
        "patient_name string, abha_id string, clinical_payload string, consent_status string, "
        "notice_date string, data_purpose string",
    )
    from datetime import datetime

    wiped = d.wipe_purged(d.apply_erasure_policy(df, datetime(2026, 7, 1)))
    for out in (wiped, d.mask_preview(df), d.erase_revoked(df), d.mask_preview(df, revoked=True)):
        text = str(out.select("patient_name", "abha_id").first())
        assert "Asha" not in text and "3456-7890" not in text
    assert d.mask_preview(df, reveal=True).first()["patient_name"] == "Asha Verma"

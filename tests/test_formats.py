"""Hand-made documents for the readers; round trips of the renderers are in test_queries."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as se
from wardgate.operators import sampling
from wardgate.operators.aliases import standardize
from wardgate.sinks import fhir_export, render
from wardgate.sources import api, fhir, files, intake, landing, messages, reports
from wardgate.workspace import new_folder

AS_OF = datetime(2026, 7, 1, 12, 34, 56)
c = F.col


def docs(spark, *bodies):
    return spark.createDataFrame([(f"d{i}", b) for i, b in enumerate(bodies)], "doc_id string, body string")


def test_labelled_blocks_crlf_and_both_separators(spark):
    body = (
        "Patient Name: A B\r\nABHA ID: None\r\nBill Amount: 12.50\r\n" + "=" * 50
        + "\r\npatient name: C\r\nNotice ID: N-1\r\n" + "-" * 50 + "\r\n\r\njust a line\r\n"
    )
    got = reports.labelled_blocks(docs(spark, body)).orderBy("patient_name").collect()
    assert [(x["patient_name"], x["abha_id"], x["bill_amount"], x["notice_id"]) for x in got] == [
        ("A B", "None", 12.5, None), ("C", None, None, "N-1"),
    ]


def test_text_report_fallbacks(spark):
    got = reports.text_report(docs(spark, "seen 2026/01/02, ref 12345678901234", "Pt. Name: Asha V.\nConsent: revoked"))
    a, b = got.orderBy("doc_id").collect()
    assert (a["patient_name"], a["abha_id"], a["notice_date"], a["consent_status"], a["notice_id"]) == (
        "Unknown", "12345678901234", "2026-01-02", "ACTIVE", "d0",
    )
    assert (b["patient_name"], b["consent_status"]) == ("Asha V.", "REVOKED")


def test_whole_report_is_searched_and_kept_on_request(spark):
    body = "x" * 5000 + "\nPatient Name: Late Name\n"
    cut = reports.text_report(docs(spark, body), payload_chars=2000).first()
    whole = reports.text_report(docs(spark, body)).first()
    assert cut["patient_name"] == "Late Name"
    assert len(cut["clinical_payload"]) < 2100 < 5000 < len(whole["clinical_payload"])


def test_pdf_text_reorders_day_first_dates(spark):
    got = reports.pdf_text(docs(spark, "Full Name: Asha\nSeen 05/06/2026\nRef No: R-77")).first()
    assert (got["patient_name"], got["notice_date"], got["notice_id"]) == ("Asha", "2026-06-05", "R-77")
    assert reports.pdf_text(docs(spark, "nothing")).first()["patient_name"] == "Unknown/Redacted"


def test_pdf_summary(spark):
    a, b = reports.pdf_summary(
        docs(spark, "Mrs. Asha Verma\n12 3456 7890 1234\nImpression: stable", "plain text, asha@sbx"), AS_OF
    ).orderBy("doc_id").collect()
    assert (a["abha_id"], a["clinical_payload"]) == ("12-3456-7890-1234", "stable")
    assert a["patient_name"].startswith("Mrs. Asha Verma")
    assert (b["abha_id"], b["clinical_payload"]) == ("asha@sbx", "plain text, asha@sbx...")
    assert b["notice_id"].startswith("N-2026-PDF-123456-") and a["notice_id"] != b["notice_id"]


def test_hl7_line_breaks_missing_segments_and_raw_text(spark):
    msh = "MSH|^~\\&|HIS|H|ADT|H|20260615150011||ADT^A08|N-1|P|2.5"
    pid = "PID|1||12-3456-7890-1234^^^X||Verma^Asha^^|||20260101|||F"
    one = f"{msh}\r{pid}\rPV1|1{'|' * 19}GRANTED\r\n{msh.replace('N-1', 'N-2')}\n"
    got = messages.hl7_records(docs(spark, one, "no message here")).orderBy("doc_id", "notice_id").collect()
    assert [(x["patient_name"], x["abha_id"], x["notice_id"], x["notice_date"]) for x in got] == [
        ("Verma Asha", "12-3456-7890-1234", "N-1", "2026-06-15"),
        (None, None, "N-2", "2026-06-15"),
        ("Unknown/Redacted", None, "d1", None),
    ]
    assert got[2]["clinical_payload"] == '{"raw_message":"no message here"}'
    assert got[1]["pid_date"] is None


def test_hl7_file_is_cut_into_messages(spark):
    path = new_folder(spark, "hl7")
    body = "".join(f"MSH|^~\\&|HIS|H|ADT|H|20260615||ADT^A08|N-{i}|P|2.5\rPID|1||id-{i}||P\r\n" for i in range(500))
    render.write_text(spark.createDataFrame([(body,)], "body string"), path)
    got = messages.hl7_records(messages.read_hl7(spark, path))
    assert got.select("notice_id", "abha_id").distinct().count() == 500


def test_fhir_bundle_and_single_resource(spark):
    bundle = (
        '{"resourceType":"Bundle","entry":[{"resource":{"resourceType":"Patient","id":"p1","identifier":'
        '[{"type":{"coding":[{"code":"MR"}]}},{"value":"12-3456-7890-1234"}],"name":[{"family":"Verma",'
        '"given":["Asha","R"]}],"meta":{"lastUpdated":"2026-01-02T03:04:05Z"}}},{"fullUrl":"x"},'
        '{"resource":{"resourceType":"Consent","id":"c1","status":"active","patient":{"reference":"Patient/p1"}}}]}'
    )
    single = '{"resourceType":"Observation","id":"o1","status":"final","code":{"coding":[{"display":"BP"}]}}'
    got = {x["notice_id"]: x for x in fhir.records(docs(spark, bundle, single, "{broken")).collect()}
    assert set(got) == {"p1", "c1", "o1"}
    assert (got["p1"]["patient_name"], got["p1"]["abha_id"], got["p1"]["notice_date"]) == (
        "Asha R Verma", "12-3456-7890-1234", "2026-01-02",
    )
    assert (got["c1"]["patient_name"], got["c1"]["consent_status"]) == ("p1", "active")
    assert got["o1"]["clinical_payload"] == '{"resource_type":"Observation","code":"BP","status":"final"}'


def test_imaging_dump(spark):
    body = (
        "(0010,0010) Patient Name: A\n(0010,0020) Patient ID: 1\n(0008,1030) Study Description: CT\n"
        "(0008,0060) Modality: MR\n---\n(0010,0010) Patient Name: B\n---\n"
    )
    got = messages.imaging_records(docs(spark, body)).orderBy("patient_name").collect()
    assert [x["patient_name"] for x in got] == ["A", "B"]
    assert got[0]["clinical_payload"] == '{"study_description":"CT","modality":"MR"}'
    assert got[1]["clinical_payload"] is None


def test_json_shapes(spark):
    bodies = (
        '[{"patient_name":"a"},{"patient_name":"b"}]', '{"data":[{"patient_name":"c"}]}', '{"patient_name":"d"}',
        '{"records":[]}', '{"patient_name":"cut',
    )
    got = files.json_records(docs(spark, *bodies)).select("patient_name")
    assert sorted(x[0] for x in got.collect()) == ["a", "b", "c", "d"]


def test_api_last_alias_counts(spark):
    got = api.records(docs(spark, '{"results":[{"pt_name":"x","Patient Name":"y","UHID":"1"}]}', '"text"')).collect()
    assert [(x["patient_name"], x["abha_id"]) for x in got] == [("y", "1")]


def test_classification(spark):
    paths = ("a/b.CSV", "a.b/c", "x.tar.gz", ".csv", "r.report")
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {x["path"]: (x["format"], x["reader"]) for x in landing.classify(df).collect()}
    assert got["a/b.CSV"] == ("CSV (Polars)", "csv")
    assert got["a.b/c"] == ("Unknown ()", None)
    assert got["x.tar.gz"] == ("Unknown (.GZ)", None)
    assert got[".csv"] == ("Unknown ()", None)
    assert got["r.report"] == ("Unknown (.REPORT)", "report")


def test_list_files(spark):
    path = new_folder(spark, "list")
    spark.range(3).write.csv(path)
    assert landing.list_files(spark, path, "*.csv").count() >= 1


def test_standardize_rejects_bad_mode(spark):
    with pytest.raises(ValueError):
        standardize(docs(spark, "x"), unknown="guess")


def test_transaction_bundle_is_json(spark):
    df = spark.createDataFrame(
        [("N-1", "id", 'Asha "A"', '{"diagnosis": "Migraine"}', "SUCCESS_LINKED")],
        "notice_id string, abha_id string, patient_name string, clinical_payload string, outcome string",
    )
    import json

    entries = fhir_export.transaction_entries(df)
    bundle = json.loads(fhir_export.bundles(entries, F.lit(0), "notice_id", "transaction").first()["bundle"])
    patient, condition = sorted((e["resource"] for e in bundle["entry"]), key=lambda x: x["resourceType"], reverse=True)
    assert bundle["type"] == "transaction" and bundle["entry"][0]["request"]["method"] == "POST"
    assert patient["name"][0]["text"] == 'Asha "A"'
    assert condition["subject"]["reference"] == f"urn:uuid:{patient['id']}"
    assert condition["code"]["coding"][0]["code"] == "37796009"


def test_landing_of_mixed_formats(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.CSV").write_text('patient_name,Notice_ID,BILL_AMOUNT\nA,n1,7\n')
    (tmp_path / "sub" / "b.json").write_text('{"patients": [\n {"patient_name": "B",\n "notice_id": "n2"}]}')
    (tmp_path / "c.xml").write_text("<all><row><patient_name>C</patient_name><abha_id>None</abha_id></row></all>")
    (tmp_path / "d.txt").write_text("Patient Name: D\nBill Amount: 3.5\n" + "=" * 20)
    (tmp_path / "e.hl7").write_text("MSH|^~\\&|H|H|A|H|20260615||ADT|n5|P|2.5\nPID|1||id5||E^F\n")
    (tmp_path / "f.fhir").write_text('{"resourceType": "Patient", "id": "n6", "name": [{"family": "F"}]}')
    (tmp_path / "g.dcm").write_text("(0010,0010) Patient Name: G\n---\n")
    (tmp_path / "h.xlsx").write_text("x")
    (tmp_path / "i.bin").write_text("x")
    got = {x["patient_name"]: x for x in intake.read_landing(spark, f"file://{tmp_path}").collect()}
    assert {k: x["format"] for k, x in got.items()} == {
        "A": "CSV", "B": "JSON", "C": "XML", "D": "TXT", "E F": "HL7", "F": "FHIR", "G": "DCM",
    }
    assert (got["A"]["bill_amount"], got["D"]["bill_amount"], got["C"]["abha_id"]) == (7.0, 3.5, None)
    _, bad = intake.take_in(spark, f"file://{tmp_path}")
    assert {(x.path.rpartition("/")[2], x.reason) for x in bad.collect()} == {
        ("h.xlsx", "needs a decoder first"), ("i.bin", "unknown kind of file"),
    }


def landed(spark, tmp_path, files, **how):
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    good, bad = intake.take_in(spark, f"file://{tmp_path}", **how)
    return (
        sorted(tuple(x) for x in good.select("patient_name", "abha_id", "notice_id").collect()),
        sorted((x.path.rpartition("/")[2], x.reason) for x in bad.collect()),
    )


def test_csv_files_keep_their_own_column_order(spark, tmp_path):
    files = {
        "a.csv": "patient_name,abha_id,notice_id\nAsha,22-1,N1\n",
        "b.csv": "notice_id,patient_name,abha_id\nN2,Ravi,22-2\n",
        "c.csv": 'patient_name,clinical_payload,notice_id\n"Mira","two\nlines, one field",N3\n',
        "d.csv": "patient_name,abha_id,notice_id\nIla,22-4,N4\nlost,1,2,3,4\n",
    }
    good, bad = landed(spark, tmp_path, files)
    assert good == [("Asha", "22-1", "N1"), ("Ila", "22-4", "N4"), ("Mira", None, "N3"), ("Ravi", "22-2", "N2")]
    assert bad == [("d.csv", "fields do not match the header")]


def test_json_layouts_and_letter_cases(spark, tmp_path):
    one = lambda n: '{"Patient_Name": "P%d", "ABHA_ID": "i%d", "notice_id": "N%d"}' % (n, n, n)
    files = {
        "lines.json": "\n".join(one(i) for i in (1, 2, 3)) + "\n{broken\n",
        "array.json": "[" + one(4) + "," + one(5) + "]",
        "pretty.json": "[\n  " + one(6) + ",\n  " + one(7) + "\n]\n",
        "wrapped.json": '{"records":\n [' + one(8) + "]}",
        "bad.json": "[\n{\n",
    }
    good, bad = landed(spark, tmp_path, files)
    assert good == [(f"P{i}", f"i{i}", f"N{i}") for i in range(1, 9)]
    assert bad == [("bad.json", "no JSON record"), ("lines.json", "no JSON record")]


def test_json_names_by_alias(spark, tmp_path):
    files = {"a.json": '{"Pt Name": "A", "health-id": "i", "REFERENCE NO": "n"}'}
    good, _ = landed(spark, tmp_path, files, name=intake.by_alias)
    assert good == [("A", "i", "n")]


def test_xml_tags_differ_per_file(spark, tmp_path):
    body = lambda i: f"<Patient_Name>P{i}</Patient_Name><abha_id>i{i}</abha_id><notice_id>N{i}</notice_id>"
    files = {
        "a.xml": f"<all><record>{body(1)}</record></all>",
        "b.xml": f"<all><patient>{body(2)}</patient><patient>{body(3)}</patient></all>",
        "c.xml": f"<?xml version='1.0'?><all><entry>{body(4)}</entry></all>",
        "d.xml": "no markup",
    }
    good, bad = landed(spark, tmp_path, files)
    assert good == [(f"P{i}", f"i{i}", f"N{i}") for i in range(1, 5)]
    assert bad == [("d.xml", "no XML record")]


def test_documents_without_records_are_rejects(spark, tmp_path):
    files = {"a.txt": "just prose", "b.hl7": "no message", "c.txt": "Patient Name: C\nNotice ID: N3\n"}
    good, bad = landed(spark, tmp_path, files)
    assert good == [("C", None, "N3")]
    assert bad == [("a.txt", "no record in the document"), ("b.hl7", "no record in the document")]


def test_hl7_is_cut_where_a_line_starts(spark, tmp_path):
    message = "MSH|^~\\&|H|H|A|H|20260615||ADT|n%d|P|2.5\nPID|1||id%d||E^F\nNTE|1|see MSH|x\n"
    text = "FHS|^~\\&|H\nBHS|^~\\&|H\n" + message % (1, 1) + message % (2, 2)
    (tmp_path / "a.hl7").write_text(text)
    want = [("id1", "n1"), ("id2", "n2")]
    for docs_ in (messages.read_hl7(spark, str(tmp_path)), reports.read_documents(spark, str(tmp_path))):
        assert sorted((r.abha_id, r.notice_id) for r in messages.hl7_records(docs_).collect()) == want


def test_pdf_summaries_stay_apart(spark):
    five = spark.createDataFrame([(f"d{i}", "x" * 300) for i in range(5)], "doc_id string, body string")
    got = reports.pdf_summary(five, datetime(2026, 1, 2, 3, 4, 5)).collect()
    assert len({r.notice_id for r in got}) == 5 and {len(r.clinical_payload) for r in got} == {303}


def test_scenario_marks_with_null_and_repeated_keys(spark):
    rows = [(None, "i", "A", "2026")] * 10 + [(f"k{i // 3}", "i", "A", "2026") for i in range(300)]
    df = spark.createDataFrame(rows, "notice_id string, abha_id string, consent_status string, notice_date string")
    got = sampling.mark_scenarios(df, datetime(2026, 1, 2)).collect()
    assert all(r.abha_id == "i" and r.consent_status == "A" for r in got if r.notice_id is None)
    assert sum(r.abha_id is None for r in got) == 45 and sum(r.consent_status == "REVOKED" for r in got) == 30


@pytest.mark.parametrize("name", ["S4_labelled_text_scan", "S10_imaging_scan"])
def test_block_scans_hold_no_whole_file(spark, tmp_path, monkeypatch, name):
    """Files of many blocks come as one row a block, not as one row a file."""
    rows = spark.range(200).selectExpr(
        "id AS o_orderkey", "id % 7 AS o_custkey", "'2-HIGH' AS o_orderpriority", "'F' AS o_orderstatus",
        "100.0D AS o_totalprice", "date'1998-01-01' AS o_orderdate", "id AS c_custkey", "id AS p_partkey",
    )
    for table in ("orders", "customer", "part"):
        rows.coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    read, seen = reports.read_documents, []
    monkeypatch.setattr(reports, "read_documents", lambda *a, **k: seen.append(read(*a, **k)) or seen[-1])
    assert se.queries()[name](spark, str(tmp_path)).select("notice_id").distinct().count() == 200
    assert seen[0].count() == 200

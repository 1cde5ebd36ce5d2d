"""Queries over file and message formats: render, land, scan, and export.

The round trips write the whole intake in a format to the shared folder and read it back; their
twins are the intake itself.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from wardgate.functions import vocab as v
from wardgate.operators import dispositions as d
from wardgate.operators import metrics as m
from wardgate.operators import naming
from wardgate.plans import sql_rules as q
from wardgate.plans.fixtures import fixture, with_fixtures
from wardgate.plans.registry import AS_OF, query
from wardgate.sinks import fhir_export, render
from wardgate.sources import api, fhir, files, intake, landing, messages, reports
from wardgate.workspace import new_folder

c = F.col
INTAKE = with_fixtures("intake")
GATED = with_fixtures("intake", gated=q.gated())
ALL = "SELECT patient_name, abha_id, clinical_payload, bill_amount, consent_status, notice_id, notice_date, data_purpose FROM "
SENT = datetime(1998, 7, 1, 8, 30, 0)


def _chunk(size: int):
    return F.floor(c("k") / size)


def _landed(spark, sf, label, size, body, **options):
    """The intake as documents of ``size`` records each, written out and read back as files."""
    docs = render.documents(fixture(spark, sf, "base"), _chunk(size), "k", body, **options)
    folder = new_folder(spark, label)
    render.write_text(docs, folder)
    return folder


# --- S: scans ---------------------------------------------------------------------------------


@query("S1_csv_scan", INTAKE + ALL + "intake")
def s1(spark, sf):
    folder = new_folder(spark, "s1")
    render.write_csv(fixture(spark, sf, "intake").select(*v.CANONICAL), folder)
    return naming.canonical_rename(files.read_csv(spark, folder))


@query("S2_json_scan", INTAKE + ALL + "intake")
def s2(spark, sf):
    """Arrays and three envelopes of twenty records, and single records, one document a line."""
    base = fixture(spark, sf, "base")
    record = F.to_json(
        F.struct(*[c(x).cast("string").alias(x) for x in v.CANONICAL]), {"ignoreNullFields": "false"}
    )
    kind = F.pmod(_chunk(20), F.lit(5))
    many = render.documents(base.filter(kind < 4), _chunk(20), "k", record, joiner=",", head="[", tail="]")
    body = c("body")
    for i, key in enumerate(v.JSON_ENVELOPES, start=1):
        wrapped = F.concat(F.lit(f'{{"{key}":'), c("body"), F.lit("}"))
        body = F.when(F.pmod("doc_id", F.lit(5)) == i, wrapped).otherwise(body)
    single = base.filter(kind == 4).select(record.alias("body"))
    folder = new_folder(spark, "s2")
    render.write_text(many.select(body.alias("body")).unionByName(single), folder)
    lines = spark.read.text(folder).select(c("value").alias("body"))
    return naming.canonical_rename(files.json_records(lines))


@query("S2_json_lines_scan", INTAKE + ALL + "intake")
def s2_lines(spark, sf):
    folder = new_folder(spark, "s2l")
    render.write_json(fixture(spark, sf, "intake"), folder)
    return naming.canonical_rename(files.read_json(spark, folder))


@query("S3_xml_scan", INTAKE + ALL + "intake")
def s3(spark, sf):
    folder = new_folder(spark, "s3")
    render.write_xml(fixture(spark, sf, "intake"), folder)
    rows = naming.drop_null_tokens(files.read_xml_any_tag(spark, folder))
    return naming.canonical_rename(rows)


BLOCKS = """SELECT patient_name, coalesce(abha_id, 'None') AS abha_id, coalesce(clinical_payload, 'None')
    AS clinical_payload, bill_amount, coalesce(consent_status, 'None') AS consent_status, notice_id
    FROM intake"""


@query("S4_labelled_text_scan", INTAKE + BLOCKS)
def s4(spark, sf):
    folder = _landed(spark, sf, "s4", 20, render.labelled_text())
    docs = reports.read_documents(spark, folder, separator="\n" + render.TEXT_SEPARATOR + "\n")
    return reports.labelled_blocks(docs).drop("doc_id")


@query("S4_split_file_scan", INTAKE + BLOCKS)
def s4_split(spark, sf):
    """The same files, cut at the separator line so that many tasks share one file."""
    folder = _landed(spark, sf, "s4s", 20, render.labelled_text(render.PDF_TEXT_SEPARATOR))
    docs = reports.read_documents(spark, folder, separator=render.PDF_TEXT_SEPARATOR + "\n")
    return reports.labelled_blocks(docs).drop("doc_id")


def _report_json(name: str) -> str:
    return f"CAST(json_object('{name}', body) AS STRING)"


_NAME = f"split_part({q.strip(q.first_match('body', v.REPORT_NAME))}, chr(10), 1)"
_PDF_NAME = f"split_part({q.strip(q.first_match('body', v.PDF_NAME))}, chr(10), 1)"
_ID = q.strip(q.first_match("body", v.REPORT_ID))


@query(
    "S5_text_report",
    with_fixtures("reports")
    + f"""SELECT doc_id, coalesce({_NAME}, 'Unknown') AS patient_name, {_ID} AS abha_id,
        replace({q.first_match('body', v.REPORT_DATE)}, '/', '-') AS notice_date,
        coalesce(upper({q.first_match('body', v.REPORT_CONSENT)}), 'ACTIVE') AS consent_status,
        coalesce({q.strip(q.first_match('body', v.REPORT_NOTICE))}, CAST(doc_id AS STRING)) AS notice_id,
        {_report_json('report')} AS clinical_payload FROM reports""",
)
def s5(spark, sf):
    return reports.text_report(fixture(spark, sf, "reports"))


@query(
    "S6_pdf_text",
    with_fixtures("reports")
    + f"""SELECT doc_id, coalesce(nullif({_PDF_NAME}, ''), 'Unknown/Redacted') AS patient_name,
        {_ID} AS abha_id, CASE WHEN substr(day, 3, 1) = '-' THEN substr(day, 7, 4) || '-' ||
            substr(day, 4, 2) || '-' || substr(day, 1, 2) ELSE day END AS notice_date,
        'ACTIVE' AS consent_status,
        coalesce({q.strip(q.first_match('body', v.PDF_NOTICE))}, CAST(doc_id AS STRING)) AS notice_id,
        {_report_json('text')} AS clinical_payload
        FROM (SELECT *, replace({q.first_match('body', v.PDF_DATE)}, '/', '-') AS day FROM reports) t""",
)
def s6(spark, sf):
    return reports.pdf_text(fixture(spark, sf, "reports"))


@query(
    "S7_pdf_summary",
    with_fixtures("reports")
    + f"""SELECT doc_id, {q.strip(f'''coalesce({q.first_match('body', (v.SUMMARY_NAME,))},
            nullif(regexp_extract(body, {q.lit(v.SUMMARY_TITLE_NAME)}, 0), ''))''')} AS patient_name,
        coalesce(replace({q.first_match('body', (v.SUMMARY_ID,))}, ' ', '-'),
            {q.first_match('body', (v.SUMMARY_ADDRESS,))}) AS abha_id,
        CASE WHEN regexp_matches(body, {q.lit(v.SUMMARY_FINDING)})
            THEN {q.strip(f"regexp_extract(body, {q.lit(v.SUMMARY_FINDING)}, 1)")}
            ELSE replace(body, chr(10), ' ') || '...' END AS clinical_payload,
        'N-2026-PDF-120000-' || left(md5(CAST(doc_id AS STRING)), 12) AS notice_id, '1998-07-01' AS notice_date, 'GRANTED' AS consent_status
        FROM reports""",
)
def s7(spark, sf):
    return reports.pdf_summary(fixture(spark, sf, "reports"), AS_OF)


MESSAGES = """SELECT patient_name, abha_id, notice_id, '1998-07-01' AS notice_date, 'ACTIVE' AS
    consent_status, '{"message_type":"ADT^A08^ADT_A01"}' AS clinical_payload, notice_date AS pid_date,
    coalesce(consent_status, 'None') AS pv1_consent FROM intake"""


@query("S8_hl7_scan", INTAKE + MESSAGES)
def s8(spark, sf):
    folder = _landed(spark, sf, "s8", 50, render.hl7_message(SENT))
    return messages.hl7_records(messages.read_hl7(spark, folder)).drop("doc_id")


@query(
    "S8_hl7_documents",
    INTAKE
    + MESSAGES
    + """ UNION ALL SELECT 'Unknown/Redacted', NULL, CAST(doc_id AS STRING), NULL, 'ACTIVE',
        CAST(json_object('raw_message', body) AS STRING), NULL, NULL FROM reports""".replace(
        "FROM reports", f"FROM ({with_fixtures('reports')} SELECT * FROM reports) r"
    ),
)
def s8_documents(spark, sf):
    """Documents of fifty messages, and reports without any message."""
    docs = render.documents(
        fixture(spark, sf, "base"), _chunk(50), "k", render.hl7_message(SENT)
    )
    return messages.hl7_records(docs.unionByName(fixture(spark, sf, "reports"))).drop("doc_id")


@query(
    "S9_fhir_scan",
    with_fixtures("base")
    + """SELECT 'Patient' AS resource_type, CASE WHEN k % 9 <> 0 THEN CAST(u AS STRING) || ' Patient' END
            AS patient_name, abha_id, CAST(NULL AS STRING) AS clinical_payload,
            'ACTIVE' AS consent_status, notice_id, CAST(NULL AS STRING) AS notice_date FROM base
        UNION ALL SELECT 'Consent', notice_id, NULL, NULL, coalesce(lower(consent_status), 'ACTIVE'),
            'consent-' || notice_id, notice_date FROM base""",
)
def s9(spark, sf):
    base = fixture(spark, sf, "base").withColumn(
        "patient_name", F.when(c("k") % 9 != 0, c("patient_name"))
    )
    docs = render.documents(
        base, _chunk(50), "k", render.fhir_entries(), joiner=",",
        head=render.BUNDLE_HEAD, tail=render.BUNDLE_TAIL,
    )
    folder = new_folder(spark, "s9")
    render.write_text(docs, folder)
    lines = spark.read.text(folder).select(F.lit("landed").alias("doc_id"), c("value").alias("body"))
    return fhir.records(lines).drop("doc_id")


FINDINGS = """SELECT k AS doc_id, CASE WHEN k % 2 = 0 THEN
    '{"resourceType":"Condition","id":"c-' || CAST(k AS STRING) || '","status":"final","code":{"coding":' ||
    '[{"system":"http://snomed.info/sct","display":"' || diag || '"}]},"meta":{"lastUpdated":"' ||
    notice_date || 'T08:30:00Z"}}'
    ELSE '{"resourceType":"Observation","id":"o-' || CAST(k AS STRING) || '","date":"' || notice_date ||
    '"}' END AS body FROM base"""


@query(
    "S9_fhir_findings",
    with_fixtures("base")
    + """SELECT k AS doc_id, CASE WHEN k % 2 = 0 THEN 'Condition' ELSE 'Observation' END AS resource_type,
        CASE WHEN k % 2 = 0 THEN '{"resource_type":"Condition","code":"' || diag || '","status":"final"}'
            ELSE '{"resource_type":"Observation","code":null,"status":null}' END AS clinical_payload,
        CASE WHEN k % 2 = 0 THEN 'c-' ELSE 'o-' END || CAST(k AS STRING) AS notice_id, notice_date,
        'ACTIVE' AS consent_status FROM base""",
)
def s9_findings(spark, sf):
    fixture(spark, sf, "base").createOrReplaceTempView("base")
    return fhir.records(spark.sql(FINDINGS)).drop("patient_name", "abha_id")


@query(
    "S10_imaging_scan",
    INTAKE
    + """SELECT patient_name, coalesce(abha_id, 'None') AS abha_id, replace(notice_date, '-', '')
        AS notice_date, notice_id, CAST(json_object('study_description', coalesce(clinical_payload, 'None'))
        AS STRING) AS clinical_payload, 'ACTIVE' AS consent_status FROM intake""",
)
def s10(spark, sf):
    folder = _landed(spark, sf, "s10", 50, render.imaging_block())
    docs = reports.read_documents(spark, folder, separator="\n---\n")
    return messages.imaging_records(docs).drop("doc_id")


@query(
    "S11_api_records",
    with_fixtures("base")
    + """SELECT k AS doc_id, patient_name, abha_id, clinical_payload, consent_status,
        CAST(NULL AS STRING) AS consent_token, notice_id, notice_date FROM base WHERE k % 31 <> 0
        UNION ALL SELECT k, patient_name, abha_id, clinical_payload, consent_status, NULL, notice_id,
        notice_date FROM base WHERE k % 31 <> 0 AND k % 6 = 1""",
)
def s11(spark, sf):
    return api.records(fixture(spark, sf, "api_docs"))


@query(
    "S11_api_unreadable",
    with_fixtures("base") + "SELECT k AS doc_id FROM base WHERE k % 31 = 0",
)
def s11_bad(spark, sf):
    return api.unreadable(fixture(spark, sf, "api_docs")).select("doc_id")


def _cases(expr: str, values: dict, otherwise: str) -> str:
    whens = " ".join(f"WHEN {q.lit(k)} THEN {q.lit(str(x))}" for k, x in values.items())
    return f"CASE {expr} {whens} ELSE {otherwise} END"


_EXT = "lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1))"


@query(
    "S12_format_classification",
    with_fixtures("manifest")
    + f"""SELECT path, n_bytes, extension,
        {_cases('extension', v.FORMAT_LABELS, "'Unknown (' || upper(extension) || ')'")} AS format,
        {_cases('extension', v.READER_BY_EXTENSION, 'NULL')} AS reader
        FROM (SELECT *, {_EXT} AS extension FROM manifest) t""",
)
def s12(spark, sf):
    return landing.classify(fixture(spark, sf, "manifest"))


@query(
    "S12_format_dispatch",
    with_fixtures("base")
    + """SELECT CASE k % 4 WHEN 0 THEN 'CSV' WHEN 1 THEN 'JSON' WHEN 2 THEN 'XML' ELSE 'TXT' END AS format,
        patient_name, CASE WHEN k % 4 = 3 THEN coalesce(abha_id, 'None') ELSE abha_id END AS abha_id,
        CASE WHEN k % 4 = 3 THEN coalesce(clinical_payload, 'None') ELSE clinical_payload END
            AS clinical_payload, bill_amount,
        CASE WHEN k % 4 = 3 THEN coalesce(consent_status, 'None') ELSE consent_status END
            AS consent_status, notice_id, CASE WHEN k % 4 <> 3 THEN notice_date END AS notice_date,
        CASE WHEN k % 4 <> 3 THEN data_purpose END AS data_purpose FROM base""",
)
def s12_dispatch(spark, sf):
    """The intake landed in four formats in one folder, and taken in by extension."""
    base = fixture(spark, sf, "base")
    root = new_folder(spark, "s12")
    kind = c("k") % 4
    render.write_csv(base.filter(kind == 0).select(*v.CANONICAL), f"{root}/a")
    render.write_json(base.filter(kind == 1), f"{root}/b")
    render.write_xml(base.filter(kind == 2), f"{root}/c")
    text = render.documents(base.filter(kind == 3), _chunk(20), "k", render.labelled_text())
    render.write_text(text, f"{root}/d")
    return intake.read_landing(spark, root)


@query(
    "S12_lossless_landing",
    with_fixtures("base")
    + """SELECT CASE WHEN k % 8 < 2 THEN 'CSV' WHEN k % 8 < 4 THEN 'JSON' WHEN k % 8 < 7 THEN 'XML' ELSE 'TXT' END
        AS format, patient_name, CASE WHEN k % 8 = 7 THEN coalesce(abha_id, 'None') ELSE abha_id END AS abha_id,
        CASE WHEN k % 8 = 7 THEN coalesce(clinical_payload, 'None') ELSE clinical_payload END
            AS clinical_payload, bill_amount,
        CASE WHEN k % 8 = 7 THEN coalesce(consent_status, 'None') ELSE consent_status END
            AS consent_status, notice_id, CASE WHEN k % 8 <> 7 THEN notice_date END AS notice_date,
        CASE WHEN k % 8 <> 7 THEN data_purpose END AS data_purpose FROM base""",
)
def s12_lossless(spark, sf):
    """Two column orders of CSV, JSON lines and envelopes with other letter cases, XML with two known record tags
    and one unknown, and labelled text, all in one folder."""
    base = fixture(spark, sf, "base")
    root = new_folder(spark, "s12l")
    kind = c("k") % 8
    fields = list(v.CANONICAL)
    shown = [c(f).alias(v.CANONICAL[f]) for f in fields]
    render.write_csv(base.filter(kind == 0).select(*fields), f"{root}/a")
    render.write_csv(base.filter(kind == 1).select(*reversed(fields)), f"{root}/b")
    base.filter(kind == 2).select(*shown).write.json(f"{root}/c")
    wrapped = base.filter(kind == 3).groupBy(_chunk(160)).agg(F.collect_list(F.struct(*shown)).alias("records"))
    wrapped.select("records").write.json(f"{root}/d")
    for i, tag in enumerate(("record", "patient", "entry"), start=4):
        rows = base.filter(kind == i).select(*fields)
        rows.write.format("xml").options(rowTag=tag, rootTag="all").save(f"{root}/e{i}")
    text = render.documents(base.filter(kind == 7), _chunk(20), "k", render.labelled_text())
    render.write_text(text, f"{root}/f")
    return intake.read_landing(spark, root)


@query(
    "S16_landing_rejects",
    with_fixtures("base")
    + """SELECT CASE WHEN k % 29 = 0 THEN 'fields do not match the header' ELSE 'accepted' END AS reason,
        notice_id || ',' || patient_name || CASE WHEN k % 29 = 0 THEN ',too,much' ELSE '' END AS line FROM base""",
)
def s16_landing(spark, sf):
    """CSV rows with fields too many: each landed line is an accepted record or a reject with its text."""
    root = new_folder(spark, "s16l")
    extra = F.when(c("k") % 29 == 0, ",too,much").otherwise("")
    lines = fixture(spark, sf, "base").select(
        F.concat("notice_id", F.lit(","), "patient_name", extra).alias("notice_id,patient_name")
    )
    lines.write.options(header=True, sep="\x01", quote="").csv(root)
    good, bad = intake.take_in(spark, root)
    accepted = good.select(F.lit("accepted").alias("reason"), F.concat_ws(",", "notice_id", "patient_name").alias("line"))
    return accepted.unionByName(bad.select("reason", c("text").alias("line")))


PEEKED = {
    "Pt_Name": "patient_name",
    "ABHA Number": "abha_id",
    "Summary": "clinical_payload",
    "bill": "bill_amount",
    "Notice_ID": "notice_id",
}


def _peek_sql() -> str:
    synonyms = naming.synonym_map()
    rows = []
    for shown, col in PEEKED.items():
        field = synonyms.get(shown.lower())
        text = "CAST(CAST(bill_amount AS BIGINT) AS STRING)" if col == "bill_amount" else col
        rows.append(
            f"SELECT source, {q.lit(shown)} AS source_col, {q.lit(field) if field else 'NULL'} AS canonical, "
            f"left(coalesce({text}, 'None'), 100) AS snippet FROM first"
        )
    return " UNION ALL ".join(rows)


@query(
    "S13_header_peek",
    with_fixtures(
        "base",
        first="""SELECT *, CAST(floor(k / 500) AS BIGINT) AS source FROM base
            QUALIFY row_number() OVER (PARTITION BY floor(k / 500) ORDER BY k) = 1""",
    )
    + _peek_sql(),
)
def s13(spark, sf):
    batch = fixture(spark, sf, "base").select(
        _chunk(500).alias("source"),
        "k",
        *[
            (c(x).cast("bigint") if x == "bill_amount" else c(x)).alias(shown)
            for shown, x in PEEKED.items()
        ],
    )
    return landing.peek(batch, "source", "k", naming.synonym_map())


_FOLDERS = {"drop": 0} | {f"drop/{f}": i for i, f in enumerate(v.LANDING_FOLDERS, start=1)}
_RANKS = {e: i for i, e in enumerate(v.READER_BY_EXTENSION)}
DISCOVERED = (
    with_fixtures("manifest").rstrip()
    + f""", discovered AS (SELECT * FROM (SELECT path, n_bytes,
        CAST({_cases(_EXT, _RANKS, 'NULL')} AS INT) AS format_rank,
        CAST({_cases("regexp_extract(path, '^(.*)/[^/]*$', 1)", _FOLDERS, 'NULL')} AS INT) AS folder_rank
        FROM manifest WHERE NOT contains(path, 'standardized_ingress_1000.csv')) t
        WHERE format_rank IS NOT NULL AND folder_rank IS NOT NULL)
    """
)


@query("S17_file_discovery", DISCOVERED + "SELECT path, n_bytes, format_rank, folder_rank FROM discovered")
def s17(spark, sf):
    found = landing.discover(fixture(spark, sf, "manifest"), "drop")
    return found.select("path", "n_bytes", "format_rank", "folder_rank")


@query(
    "S17_next_file",
    DISCOVERED + "SELECT path FROM discovered ORDER BY format_rank, folder_rank, path LIMIT 1",
)
def s17_next(spark, sf):
    found = landing.discover(fixture(spark, sf, "manifest"), "drop")
    return landing.next_file(found).select("path")


# --- K: exports -------------------------------------------------------------------------------


@query("K6_csv_master", GATED + f"SELECT {q.STORED_COLUMNS.replace('surgical_truth,', '')} FROM gated")
def k6_master(spark, sf):
    return _csv_round_trip(spark, sf, "k6m", F.lit(True))


@query(
    "K6_csv_compliant",
    GATED
    + f"""SELECT {q.STORED_COLUMNS.replace('surgical_truth,', '')} FROM gated
        WHERE ingest_status = 'PROCESSED'""",
)
def k6_compliant(spark, sf):
    return _csv_round_trip(spark, sf, "k6c", c("ingest_status") == "PROCESSED")


def _csv_round_trip(spark, sf, label, keep):
    gated = d.apply_gate(fixture(spark, sf, "intake")).filter(keep)
    names = [x.strip() for x in q.STORED_COLUMNS.split(",") if x.strip() != "surgical_truth"]
    folder = new_folder(spark, label)
    render.write_csv(gated.select(*names), folder)
    back = files.read_csv_as_named(spark, folder)
    # A missing id is the empty string after the gate; CSV reads it as null.
    return back.withColumns(
        {
            "bill_amount": c("bill_amount").cast("double"),
            "abha_id": F.coalesce("abha_id", F.lit("")),
        }
    )


@query(
    "K6_csv_audit_trail",
    with_fixtures("intake", erased=q.ERASED)
    + """SELECT notice_id, CASE WHEN evaluation = 'PURGED' THEN 'REDACTED' ELSE patient_name END
        AS patient_name, outcome FROM erased""",
)
def k6_audit(spark, sf):
    out = d.wipe_purged(m.linked_outcomes(fixture(spark, sf, "intake"), AS_OF))
    folder = new_folder(spark, "k6a")
    render.write_csv(out.select("notice_id", "patient_name", "outcome"), folder)
    return files.read_csv_as_named(spark, folder)


COLLECTION = f"""SELECT 'urn:uuid:' || notice_id AS full_url, '{{"resourceType":"Patient","identifier":' ||
    '[{{"system":"{v.FHIR_ID_SYSTEM}","value":"' || abha_id || '"}}],"name":[{{"text":"' || patient_name ||
    '"}}],"extension":[{{"url":"{v.FHIR_CONSENT_EXTENSION}","valueString":' ||
    coalesce('"' || consent_status || '"', 'null') || '}},{{"url":"{v.FHIR_NOTICE_EXTENSION}",' ||
    '"valueString":"' || notice_id || '"}}]}}' AS resource FROM gated WHERE ingest_status = 'PROCESSED'"""


@query("K7_fhir_collection", GATED + COLLECTION)
def k7(spark, sf):
    return fhir_export.collection_entries(d.apply_gate(fixture(spark, sf, "intake")))


@query(
    "K7_fhir_bundles",
    GATED
    + f"""SELECT CAST(CAST(regexp_extract(full_url, '([0-9]+)$', 1) AS BIGINT) // 100 AS BIGINT)
        AS bundle_id, '{{"resourceType":"Bundle","type":"collection","entry":[' ||
        string_agg('{{"fullUrl":"' || full_url || '","resource":' || resource || '}}', ','
            ORDER BY full_url) || ']}}' AS bundle FROM ({COLLECTION}) t GROUP BY ALL""",
)
def k7_bundles(spark, sf):
    entries = fhir_export.collection_entries(d.apply_gate(fixture(spark, sf, "intake")))
    number = F.regexp_extract("full_url", "([0-9]+)$", 1).cast("bigint")
    return fhir_export.bundles(entries, F.floor(number / 100), "full_url", "collection").drop("part")


@query(
    "K7_bundle_sizes",
    GATED
    + f"""SELECT CAST(CAST(regexp_extract(full_url, '([0-9]+)$', 1) AS BIGINT) % 3 AS BIGINT) AS bundle_id,
        CAST(ceil(count(*) / 250.0) AS BIGINT) AS bundles, CAST(count(*) AS BIGINT) AS entries,
        CAST(least(count(*), 250) AS BIGINT) AS largest FROM ({COLLECTION}) t GROUP BY ALL""",
)
def k7_sizes(spark, sf):
    """Three chunks of any size, cut into bundles of at most 250 entries: their number, entries and largest size."""
    entries = fhir_export.collection_entries(d.apply_gate(fixture(spark, sf, "intake")))
    number = F.regexp_extract("full_url", "([0-9]+)$", 1).cast("bigint")
    made = fhir_export.bundles(entries, number % 3, "full_url", "collection", most=250)
    held = F.size(F.from_json("bundle", "struct<entry: array<struct<fullUrl: string>>>")["entry"]).cast("bigint")
    return made.withColumn("held", held).groupBy("bundle_id").agg(
        F.count("*").alias("bundles"), F.sum("held").alias("entries"), F.max("held").alias("largest")
    )


_H = "sha256(notice_id)"
_UUID = (
    f"substr({_H}, 1, 8) || '-' || substr({_H}, 9, 4) || '-' || substr({_H}, 13, 4) || '-' || "
    f"substr({_H}, 17, 4) || '-' || substr({_H}, 21, 12)"
)


@query(
    "K8_fhir_transaction",
    with_fixtures(
        "intake",
        erased=q.ERASED,
        linked=f"""SELECT *, {_UUID} AS pid, CASE WHEN clinical_payload IS NULL THEN 'None'
            WHEN NOT json_valid(clinical_payload) THEN clinical_payload
            ELSE coalesce(json_extract_string(clinical_payload, '$.diagnosis'), 'Unknown Condition') END
            AS txt FROM erased WHERE outcome = 'SUCCESS_LINKED'""",
    )
    + f"""SELECT notice_id, 1 AS seq, 'Patient' AS url, '{{"resourceType":"Patient","id":"' || pid ||
        '","identifier":[{{"system":"{v.FHIR_TRANSACTION_ID_SYSTEM}","value":' ||
        coalesce('"' || abha_id || '"', 'null') || '}}],"name":[{{"text":"' || patient_name || '"}}]}}'
        AS resource FROM linked
        UNION ALL SELECT notice_id, 2, 'Condition', '{{"resourceType":"Condition","subject":' ||
        '{{"reference":"urn:uuid:' || pid || '"}},"code":{{"coding":[{{"system":"{v.SNOMED_SYSTEM}",' ||
        '"code":"' || {q.snomed('txt', v.SNOMED_FALLBACK)} || '","display":"' || txt || '"}}],"text":"' ||
        txt || '"}}}}' FROM linked""",
)
def k8(spark, sf):
    out = m.linked_outcomes(fixture(spark, sf, "intake"), AS_OF)
    return fhir_export.transaction_entries(out)


@query(
    "K12_rendered_text",
    INTAKE
    + """SELECT notice_id, 'Patient Name: ' || patient_name || chr(10) || 'ABHA ID: ' ||
        coalesce(abha_id, 'None') || chr(10) || 'Notice ID: ' || notice_id || chr(10) ||
        'Notice Date: ' || notice_date || chr(10) || 'Bill Amount: ' || CAST(bill_amount AS STRING) ||
        chr(10) || 'Consent Status: ' || coalesce(consent_status, 'None') || chr(10) ||
        'Clinical Payload: ' || coalesce(clinical_payload, 'None') || chr(10) || repeat('=', 50) AS body
        FROM intake""",
)
def k12_text(spark, sf):
    return fixture(spark, sf, "intake").select("notice_id", render.labelled_text().alias("body"))


@query(
    "K12_rendered_hl7",
    INTAKE
    + """SELECT notice_id, 'MSH|^~' || chr(92) || '&|HIS|HOSPITAL|ADT|HOSPITAL|19980701083000||ADT^A08^ADT_A01|'
        || notice_id || '|P|2.5' || chr(13) || 'PID|1||' || coalesce(abha_id, 'None') || '||' ||
        patient_name || '^^^^|||' || replace(notice_date, '-', '') || '|||M' || chr(13) ||
        'PV1|1|I|ICU^ICU^1' || repeat('|', 17) || coalesce(consent_status, 'None') || chr(13) AS body
        FROM intake""",
)
def k12_hl7(spark, sf):
    return fixture(spark, sf, "intake").select("notice_id", render.hl7_message(SENT).alias("body"))

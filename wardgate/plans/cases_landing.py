"""Queries over landings that hold more than clean files: what lands is a record or a reject, whatever stands beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardgate.plans.fixtures import fixture, with_fixtures
from wardgate.plans.registry import query
from wardgate.sinks import render
from wardgate.sources import intake
from wardgate.workspace import new_folder

c = F.col


def _verdicts(landed: intake.Landed, *shown: str) -> DataFrame:
    """``reason`` and ``line`` of every record and reject of a landing."""
    good, bad = landed
    accepted = good.select(F.lit("accepted").alias("reason"), F.concat_ws("|", *shown).alias("line"))
    return accepted.unionByName(bad.select("reason", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("line")))


def _documents(df: DataFrame, size: int, element, head: str, tail: str, folder: str) -> None:
    """JSON documents of ``size`` records, one a file, an element a line."""
    some = F.sort_array(F.collect_list(F.struct("k", element.alias("e"))))
    body = F.concat(F.lit(head), F.array_join(F.transform(some, lambda x: x["e"]), ",\n"), F.lit(tail))
    docs = df.groupBy(F.floor(c("k") / size).alias("chunk")).agg(body.alias("value"))
    docs.write.partitionBy("chunk").text(folder)


@query(
    "S1_quoted_breaks",
    with_fixtures("base")
    + """SELECT 'accepted' AS reason, notice_id || '|' || patient_name || chr(10) || 'says "' || CAST(k AS STRING) || '", twice' AS line
        FROM base WHERE k % 3 <> 0
    UNION ALL SELECT 'no known field', CAST(k AS STRING) || ',' || patient_name FROM base WHERE k % 3 = 0""",
)
def s1_breaks(spark, sf):
    """CSV with line breaks and quotes in quoted fields, read in splits, beside CSV of unknown headers."""
    base, root = fixture(spark, sf, "base"), new_folder(spark, "s1q")
    said = F.concat("patient_name", F.lit('\nsays "'), c("k").cast("string"), F.lit('", twice'))
    rows = base.filter("k % 3 <> 0").select("notice_id", said.alias("clinical_payload"))
    rows.write.options(header=True, escape='"', quoteAll=True).csv(f"{root}/a")
    base.filter("k % 3 = 0").select(c("k").alias("number"), c("patient_name").alias("colour")).write.option("header", True).csv(f"{root}/b")
    return _verdicts(intake.take_in(spark, root), "notice_id", "clinical_payload")


@query(
    "S2_mixed_elements",
    with_fixtures("base")
    + """SELECT CASE WHEN k % 5 = 0 AND k % 2 = 1 OR k % 10 = 4 THEN 'element is no object' WHEN k % 22 = 6 THEN 'no JSON record'
            WHEN k % 22 = 8 THEN 'no known field' ELSE 'accepted' END AS reason,
        CASE WHEN k % 5 = 0 AND k % 2 = 1 THEN CAST(k AS STRING) WHEN k % 10 = 4 THEN '[' || CAST(k AS STRING) || ',"{"]'
            WHEN k % 22 = 6 THEN '{broken ' || CAST(k AS STRING) WHEN k % 22 = 8 THEN '{"number":' || CAST(k AS STRING) || '}'
            ELSE notice_id END AS line
        FROM base""",
)
def s2_mixed(spark, sf):
    """Arrays and envelopes over many lines whose elements are objects, numbers and lists, beside JSON lines of which some are broken."""
    base, root = fixture(spark, sf, "base"), new_folder(spark, "s2m")
    k = c("k").cast("string")
    record = F.to_json(F.struct("notice_id", F.struct(F.struct("diag").alias("x"), F.lit("{ [").alias("y")).alias("more")))
    odd = c("k") % 2 == 1
    # whatever its parity, a number that is four modulo ten is a list here
    element = F.when(c("k") % 10 == 4, F.concat(F.lit("["), k, F.lit(',"{"]'))).when((c("k") % 5 == 0) & odd, k).otherwise(record)
    listed = base.filter(odd | (c("k") % 10 == 4))
    kind = F.floor(c("k") / 4000) % 2
    _documents(listed.filter(kind == 0), 4000, element, "[\n", "\n]\n", f"{root}/a")
    envelope = '{\n"meta": {"of": {"page": 1}},\n"records": [\n'
    _documents(listed.filter(kind == 1), 4000, element, envelope, '\n],\n"next": [{"notice_id": "none"}]\n}\n', f"{root}/b")
    line = F.when(c("k") % 22 == 6, F.concat(F.lit("{broken "), k)).when(c("k") % 22 == 8, F.concat(F.lit('{"number":'), k, F.lit("}")))
    lines = base.filter(~odd & (c("k") % 10 != 4)).select(F.coalesce(line, F.to_json(F.struct("notice_id"))).alias("value"))
    render.write_text(lines.withColumnRenamed("value", "body"), f"{root}/c")
    return _verdicts(intake.read_json_files(spark, root, ".txt", intake.by_canonical), "notice_id")


@query(
    "S9_split_bundles",
    with_fixtures("base")
    + """SELECT CASE WHEN k % 9 = 0 THEN 'no record in the document' ELSE 'accepted' END AS reason,
        CASE WHEN k % 9 = 0 THEN '{"request":{"url":"' || CAST(k AS STRING) || '"}}' ELSE notice_id || '|' || patient_name END AS line
        FROM base""",
)
def s9_split(spark, sf):
    """Bundles of many lines, cut into their entries while they are read; entries without a resource are rejects."""
    base, root = fixture(spark, sf, "base"), new_folder(spark, "s9s")
    name = F.array(F.struct(c("patient_name").alias("family")))
    resource = F.struct(F.lit("Patient").alias("resourceType"), c("notice_id").alias("id"), name.alias("name"))
    request = F.to_json(F.struct(F.struct(c("k").cast("string").alias("url")).alias("request")))
    entry = F.when(c("k") % 9 == 0, request).otherwise(F.to_json(F.struct(resource.alias("resource"))))
    _documents(base, 6000, entry, '{"resourceType": "Bundle",\n"meta": {"tag": {"x": "]"}}, "entry": [\n', '\n], "total": 1}\n', f"{root}/a")
    return _verdicts(intake.read_document_files(spark, root, ".txt", "fhir"), "notice_id", "patient_name")


@query(
    "S4_block_verdicts",
    with_fixtures("base")
    + """SELECT CASE WHEN k % 7 = 0 THEN 'no record in the document' ELSE 'accepted' END AS reason,
        CASE WHEN k % 7 = 0 THEN 'seen by nobody, ' || CAST(k AS STRING) ELSE notice_id || '|' || patient_name END AS line FROM base""",
)
def s4_blocks(spark, sf):
    """Labelled blocks of text read in splits; a block without a label is a reject of its own."""
    base, root = fixture(spark, sf, "base"), new_folder(spark, "s4b")
    block = F.concat(F.lit("Patient Name: "), "patient_name", F.lit("\nNotice ID: "), "notice_id")
    block = F.when(c("k") % 7 == 0, F.concat(F.lit("seen by nobody, "), c("k").cast("string"))).otherwise(block)
    rule = F.when(c("k") % 2 == 0, "\n" + "=" * 20).otherwise("\n-----")
    render.write_text(base.select(F.concat(block, rule).alias("body")), root)
    return _verdicts(intake.read_document_files(spark, root, ".txt", "report"), "notice_id", "patient_name")


@query(
    "S8_split_messages",
    with_fixtures("base")
    + """SELECT CASE WHEN k % 5000 = 0 THEN 'no record in the document' ELSE 'accepted' END AS reason,
        CASE WHEN k % 5000 = 0 THEN 'note ' || CAST(k AS STRING) ELSE notice_id END AS line FROM base""",
)
def s8_split(spark, sf):
    """Messages of whole files found in splits, and files without any."""
    base, root = fixture(spark, sf, "base"), new_folder(spark, "s8s")
    message = F.concat(F.lit("MSH|^~\\&|H|H|A|H|20260615||ADT|"), "notice_id", F.lit("|P|2.5\rPID|1||x||E^F\rNTE|1|see MSH|y"))
    render.write_text(base.filter("k % 5000 <> 0").select(message.alias("body")), f"{root}/a")
    notes = base.filter("k % 5000 = 0").select("k", F.concat(F.lit("note "), c("k").cast("string")).alias("value"))
    notes.write.partitionBy("k").text(f"{root}/b")
    return _verdicts(intake.read_document_files(spark, root, ".txt", "hl7"), "notice_id")

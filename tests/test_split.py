"""Records over many splits: every tried file must give the same whether its splits are large or a few bytes."""

import json
import random

import pytest
from pyspark.sql import functions as F

from wardgate.functions import vocab as v
from wardgate.sinks import fhir_export
from wardgate.sources import intake, split


@pytest.fixture(params=["128m", "23b"])
def splits(request, spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield request.param
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def landed(spark, tmp_path, files):
    for name, text in files.items():
        (tmp_path / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    good, bad = intake.take_in(spark, f"file://{tmp_path}")
    of = lambda r: r.path.rpartition("/")[2]
    records = sorted(((of(r), r.patient_name, r.clinical_payload, r.notice_id) for r in good.collect()), key=str)
    return records, sorted(((of(r), r.text, r.reason) for r in bad.collect()), key=str)


def test_odd_files_do_not_stop_the_landing(spark, tmp_path):
    files = {
        "a.csv": "patient_name,notice_id\nAsha,N1\n",
        "b.csv": "colour,size\nred,1\n\"b,\nlue\",2\n",
        "c.xml": "<all><record><colour>red</colour></record><record><patient_name>C</patient_name></record></all>",
        "d.xml": "<all><thing><colour>red</colour></thing></all>",
        "e.csv": "",
        "f.json": "",
        "g.xml": "<!-- nothing -->",
    }
    good, bad = landed(spark, tmp_path, files)
    assert [x for x in good if x[1]] == [("a.csv", "Asha", None, "N1"), ("c.xml", "C", None, None)]
    assert [(f, r) for f, _, r in bad] == [
        ("b.csv", "no known field"), ("b.csv", "no known field"), ("d.xml", "no known field"), ("g.xml", "no XML record"),
    ]
    assert bad[0][1] == '"b,\nlue",2' and bad[2][1] == '{"colour":"red"}'


JSON = {
    "mixed.json": ('[{"patient_name":"A"},5,{"notice_id":"n"}]', ["A", None], ["5"]),
    "lists.json": ('[{"patient_name":"B"},[1,2],null,"s{}"]', ["B"], ["[1,2]", "null", "s{}"]),
    "none.json": ('{"records":"none","patient_name":"C"}', ["C"], []),
    "broken_first.json": ('{broken\n{"patient_name":"D"}\n{"patient_name":"E"}\n', ["D", "E"], ["{broken"]),
    "unknown.json": ('{"colour":"red"}\n{"patient_name":"F"}', ["F"], ['{"colour":"red"}']),
    "pretty.json": ('{\n "meta": {"page": {"n": 1}},\n "records": [\n  {"patient_name": "G"},\n  7,\n  {"patient_name": "H {\\"[", "x": {"y": [{}]}}\n ],\n'
                    ' "more": [{"patient_name": "not a record"}]\n}\n', ["G", 'H {"['], ["7"]),
    "array.json": ('[\n{"patient_name": "I"}\n,\n[1,\n2],\n{"patient_name": "J"},\n "end"\n]\n\n', ["I", "J"], ["[1,2]", "end"]),
    "commas.json": ('[\n{"patient_name": "Q"},\n{"patient_name": "R"}\n]\n', ["Q", "R"], []),
    "after.json": ('{"patient_name":"S"}, {"patient_name":"T"}\n{"patient_name":"U"}\n{"patient_name":"V"} tail\n{"patient_name":"W"}',
                   ["U", "W"], ['{"patient_name":"S"},{"patient_name":"T"}', '{"patient_name":"V"}tail']),
    "two.json": ('{\n"patient_name": "K"\n}\n{\n"patient_name": "L"\n}', ["K", "L"], []),
    "cut.json": ('[\n{"patient_name": "M"},\n{"patient_name": "N"', ["M"], ['[\n{"patient_name": "N"]']),
    "empty.json": ("[\n]\n", [], []),
    "no_objects.json": ('{"data":\n [1,\n"x"]}', [], ["1", "x"]),
    "string_key.json": ('{"patient_name":\n "say \\"records\\": [{", "data": [\n{"patient_name": "O"}]}', ["O"], []),
}


def test_json_documents(spark, tmp_path, splits):
    good, bad = landed(spark, tmp_path, {k: text for k, (text, _, _) in JSON.items()})
    for name, (_, names, rejects) in JSON.items():
        assert sorted(x[1] or "" for x in good if x[0] == name) == sorted(n or "" for n in names), name
        assert sorted(x[1].replace(" ", "") for x in bad if x[0] == name) == sorted(r.replace(" ", "") for r in rejects), name


def test_quoted_line_breaks(spark, tmp_path, splits):
    rng = random.Random(5)
    rows, text = [], 'patient_name,clinical_payload,notice_id\n'
    for i in range(60):
        payload = "".join(rng.choice(['a', '"', "\n", ",", "é", " "]) for _ in range(rng.randrange(12))).strip() or "x"
        rows.append(("a.csv", f"P{i}", payload, f"N{i}"))
        quoted = payload.replace('"', '""')
        text += f'P{i},"{quoted}",N{i}\n'
    text += "too,many,fields,here\n\n"
    stray = 'patient_name,notice_id\nA,N1\nB,"N2\nC,N3\n'
    good, bad = landed(spark, tmp_path, {"a.csv": text, "stray.csv": stray})
    assert [x for x in good if x[0] == "a.csv"] == sorted(rows, key=str)
    assert [x for x in good if x[0] == "stray.csv"] == [("stray.csv", "A", None, "N1")]
    assert bad == [
        ("a.csv", "too,many,fields,here", "fields do not match the header"),
        ("stray.csv", 'B,"N2', "a quote is never closed"), ("stray.csv", "C,N3", "a quote is never closed"),
    ]


def test_bundles(spark, tmp_path, splits):
    entries = [{"resource": {"resourceType": "Patient", "id": f"p{i}", "name": [{"family": f"F{i} {{["}]}} for i in range(25)]
    entries[3] = {"request": {"method": "POST"}}
    entries[7] = 5
    files = {
        "a.fhir": json.dumps({"resourceType": "Bundle", "meta": {"x": {"y": 1}}, "entry": entries, "link": [{"a": {}}]}, indent=1),
        "b.fhir": json.dumps({"entry": entries[:3], "resourceType": "Bundle"}),
        "c.fhir": json.dumps({"resourceType": "Consent", "id": "c1", "status": "active"}),
        "d.fhir": json.dumps({"resourceType": "List", "id": "l1", "entry": [{"item": {"a": 1}}, {"item": {"a": 2}}]}),
        "e.fhir": json.dumps({"resourceType": "Bundle"}),
        "f.fhir": "no json",
    }
    good, bad = landed(spark, tmp_path, files)
    ids = lambda f: sorted(x[3] for x in good if x[0] == f)
    assert ids("a.fhir") == sorted(f"p{i}" for i in range(25) if i not in (3, 7))
    assert ids("b.fhir") == ["p0", "p1", "p2"] and ids("c.fhir") == ["c1"] and ids("d.fhir") == ["l1"]
    assert [x[0] for x in bad] == ["a.fhir", "a.fhir", "e.fhir", "f.fhir"]


def test_blocks_and_messages(spark, tmp_path, splits):
    block = lambda i: f"Patient Name: P{i}\nNotice ID: N{i}\n"
    hl7 = lambda i: f"MSH|^~\\&|H|H|A|H|20260615||ADT|n{i}|P|2.5\rPID|1||id{i}||E^F{i}\rNTE|1|see MSH|x\r"
    files = {
        "a.txt": "just prose\n===\n" + "\n----\n".join(block(i) for i in range(9)) + "=" * 12 + "more prose ---------- \n" + block(9),
        "b.txt": "prose alone",
        "c.hl7": "FHS|^~\\&|H\rBHS|^~\\&|H\r" + "".join(hl7(i) for i in range(9)),
        "d.hl7": "a note\n" + hl7(20).replace("\r", "\n") + hl7(21).replace("\r", "\r\n"),
        "e.hl7": "no message",
        "f.dcm": "---\n" + "".join(f"(0010,0010) Patient Name: D{i}\n(0020,000D) Uid: u{i}\n---\n" for i in range(9)) + "trailing words\n---\n",
    }
    good, bad = landed(spark, tmp_path, files)
    of = lambda f: sorted(x[3] for x in good if x[0] == f)
    assert of("a.txt") == sorted(f"N{i}" for i in range(10))
    assert of("c.hl7") == sorted(f"n{i}" for i in range(9)) and of("d.hl7") == ["n20", "n21"]
    assert of("f.dcm") == sorted(f"u{i}" for i in range(9))
    assert sorted((f, t.strip()) for f, t, _ in bad) == [
        ("a.txt", "just prose"), ("a.txt", "more prose"), ("b.txt", "prose alone"), ("d.hl7", "a note"), ("e.hl7", "no message"),
        ("f.dcm", "trailing words"),
    ]


def test_xml_tags_beside_and_inside_one_another(spark, tmp_path, splits):
    field = lambda i: f"<patient_name>P{i}</patient_name><notice_id>N{i}</notice_id>"
    files = {
        "both.xml": f"<all>\n<record>{field(1)}</record>\n<patient>{field(2)}</patient>\n</all>",
        "inside.xml": f"<all><patient><record>{field(3)}</record></patient>\n<patient>{field(4)}</patient></all>",
        "item.xml": f"<all><record>{field(5)}<item>x</item><item>y</item></record></all>",
        "root.xml": f"<?xml version='1.0'?>\n<!-- <record> -->\n<all\n>\n<entry>{field(6)}</entry>\n<entry>{field(7)}</entry></all>",
        "none.xml": "no markup",
    }
    good, bad = landed(spark, tmp_path, files)
    assert sorted((x[0], x[3]) for x in good) == [
        ("both.xml", "N1"), ("both.xml", "N2"), ("inside.xml", "N3"), ("inside.xml", "N4"), ("item.xml", "N5"), ("root.xml", "N6"), ("root.xml", "N7"),
    ]
    assert bad == [("none.xml", "no markup", "no XML record")]


def test_xml_children_without_a_record_are_rejects(spark, tmp_path, splits):
    field = lambda i: f"<patient_name>P{i}</patient_name><notice_id>N{i}</notice_id>"
    files = {
        "beside.xml": f"<all>\n<!-- <thing>\n<thing/> -->\n<record>{field(1)}</record>\n<thing a='1>2'><colour>red</colour>\n <b/>x</thing>\n"
                      f"<patient>{field(2)}</patient><group><record>{field(3)}</record></group>\n<empty/>\n</all>\n",
        "two.xml": f"<all><entry>{field(4)}</entry><other><![CDATA[<a>]]></other><entry>{field(5)}</entry></all>",
        "root.xml": f"<record>{field(6)}</record>",
        "stray.xml": f"<all></x><record>{field(7)}</record><thing/></all>",
    }
    good, bad = landed(spark, tmp_path, files)
    assert sorted(x[3] for x in good) == [f"N{i}" for i in range(1, 8)]
    assert sorted(bad) == [
        ("beside.xml", "<empty/>", "no record tag"), ("beside.xml", "<thing a='1>2'><colour>red</colour>\n <b/>x</thing>", "no record tag"),
        ("two.xml", "<other><![CDATA[<a>]]></other>", "no record tag"),
    ]


def test_a_bundle_is_read_by_several_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        entries = [{"resource": {"resourceType": "Patient", "id": f"p{i}"}} for i in range(2000)]
        (tmp_path / "a.fhir").write_text(json.dumps({"resourceType": "Bundle", "entry": entries}))
        raw = split.pieces(spark, str(tmp_path), "}")
        assert raw.select(F.spark_partition_id()).distinct().count() > 8
        parts = split.json_elements(spark, str(tmp_path), ("entry",))
        assert parts.count() == 2000 and parts.where("NOT listed").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_elements_are_parsed_once_for_fields_and_verdicts(spark):
    """What is asked of the verdict does not repeat the parsing of the members below it."""
    docs = spark.createDataFrame([("a", '{"Patient_Name":"A"}'), ("a", '{"x":1}'), ("a", "[2]")], "path string, body string")
    good, bad = intake.json_fields(docs, intake.by_canonical, intake.known_names())
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map_entries(") == 1
    assert [(r.path, r.patient_name) for r in good.collect()] == [("a", "A")]
    assert sorted(r.reason for r in bad.collect()) == ["element is no object", "no known field"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bundles_and_json_are_cut_and_parsed_once_for_records_and_rejects(spark, tmp_path):
    entries = ",\n".join(
        '{"resource": {"resourceType": "Patient", "id": "N-%d", "name": [{"family": "a } ]"}]}}' % i if i % 3 else '{"request": {"n": %d}}' % i for i in range(30)
    )
    (tmp_path / "a.txt").write_text('{"resourceType": "Bundle", "meta": {"x": ["]"]},\n"entry": [\n' + entries + '\n], "total": 1}\n')
    good, bad = intake.read_document_files(spark, str(tmp_path), ".txt", "fhir")
    assert sorted(r.notice_id for r in good.collect()) == sorted(f"N-{i}" for i in range(30) if i % 3)
    assert sorted(r.text for r in bad.collect()) == sorted('{"request":{"n":%d}}' % i for i in range(0, 30, 3))
    assert "Scan text" not in _plan(good.select("path").union(bad.select("path")))
    (tmp_path / "b.json").write_text('{"records": [\n{"notice_id": "x", "more": {"y": "{ ["}},\n7, [8, "{"],\n{"number": 9}\n], "next": [{"notice_id": "none"}]}\n')
    (tmp_path / "c.json").write_text('{"notice_id": "y"}\t\n{"notice_id": "z"}\n{broken\n')
    good, bad = intake.read_json_files(spark, str(tmp_path), ".json", intake.by_canonical)
    assert sorted(r.notice_id for r in good.collect()) == ["x", "y", "z"]
    reasons = {"".join(r.text.split()): r.reason for r in bad.collect()}
    assert reasons == {
        "7": "element is no object", '[8,"{"]': "element is no object", '{"number":9}': "no known field", "{broken": "no JSON record",
    }
    assert "Scan text" not in _plan(good.select("path").union(bad.select("path")))


def test_records_are_found_without_sorting_every_line(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Notice ID: 1\n=====\nNotice ID: 2\nmore\n-----\n\nNotice ID: 3\n")
    blocks = split.text_blocks(spark, str(tmp_path), v.BLOCK_SEPARATOR)
    assert sorted(" ".join(r.text.split()) for r in blocks.collect()) == ["Notice ID: 1", "Notice ID: 2 more", "Notice ID: 3"]
    assert "SortAggregate" not in _plan(blocks)


def test_known_tags_of_files_with_comments_and_text_beside_tags(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<?xml version="1.0"?>\n<!-- <item> --><all><entry/>\n<patient>a</patient><!-- b --><row x="1"/></all>')
    (tmp_path / "b.xml").write_text("<all>\n  <recorder>x < y</recorder>\n</all>")
    lines = split.pieces(spark, str(tmp_path))
    got = {r.path[-5:]: (sorted(r.tags), r.root, r.child) for r in split.known_tags(lines, v.XML_RECORD_TAGS).collect()}
    assert got == {"a.xml": (["patient", "row"], "all", "entry"), "b.xml": ([], "all", "recorder")}
    assert "array_intersect" not in _plan(split.known_tags(lines, v.XML_RECORD_TAGS))  # no tag list is built for lines without a known tag


def test_entries_of_bundles_are_worked_out_once(spark, tmp_path):
    rows = [(f"u{i % 40}", '{"n":%d}' % (i % 45), i % 2) for i in range(100)] + [(None, "{}", None)]
    spark.createDataFrame(rows, "full_url string, resource string, c int").write.parquet(f"{tmp_path}/source")
    entries = spark.read.parquet(f"{tmp_path}/source")
    made = fhir_export.bundles(entries.select("full_url", "resource", "c"), F.col("c"), "full_url", "collection", most=7)
    got = made.collect()
    held = [x["fullUrl"] for r in got for x in json.loads(r.bundle)["entry"]]
    assert len(got) == 17 and sorted(held) == sorted(r[0] for r in rows if r[0])
    assert str(tmp_path) not in made._jdf.queryExecution().toString()

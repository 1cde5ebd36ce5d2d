from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardgate.operators import tables as tb
from wardgate.plans import flows
from wardgate.streaming.incremental import intake_stream
from wardgate.workspace import new_folder

AS_OF = datetime(2026, 7, 1, 12)
SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.StringType())])
c = F.col


def rows(df):
    return sorted((tuple(x) for x in df.collect()), key=str)


def batch(spark, *data):
    return spark.createDataFrame(list(data), "k string, v string, seq int")


@pytest.fixture
def table(spark):
    return tb.KeyedTable(spark, new_folder(spark, "t"), SCHEMA, "k")


def test_last_arrival_wins_and_null_keys_stay_apart(spark):
    df = batch(spark, ("a", "1", 1), ("a", "2", 2), (None, "x", 1), (None, "x", 1), ("b", "3", 1))
    assert rows(tb.keep_last(df, "k", "seq").select("k", "v")) == rows(
        spark.createDataFrame([("a", "2"), ("b", "3"), (None, "x"), (None, "x")], SCHEMA)
    )


def test_upsert_twice_is_upsert_once(spark):
    target = spark.createDataFrame([("a", "0"), ("z", "9")], SCHEMA)
    new = batch(spark, ("a", "1", 1), ("b", "2", 1))
    once = tb.upsert(target, new, "k", "seq")
    twice = tb.upsert(once, new, "k", "seq")
    assert rows(once) == rows(twice) == [("a", "1"), ("b", "2"), ("z", "9")]


def test_table_applies_batches_in_order(spark, table):
    table.upsert(batch(spark, ("a", "1", 1), ("b", "1", 1)), "seq")
    table.upsert(batch(spark, ("a", "2", 1)), "seq")
    table.upsert(batch(spark, ("a", "3", 1), ("c", "3", 1)), "seq")
    want = [("a", "3"), ("b", "1"), ("c", "3")]
    assert rows(table.current()) == want
    table.compact()
    assert rows(table.current()) == want


def test_a_repeated_batch_changes_nothing(spark, table):
    new = batch(spark, ("a", "1", 1), (None, "x", 1), (None, "x", 1), (None, "y", 1))
    want = [("a", "1"), (None, "x"), (None, "x"), (None, "y")]
    for _ in range(3):
        table.upsert(new, "seq")
        assert rows(table.current()) == sorted(want, key=str)


def files_of(table):
    return {r[0] for r in table._rows().select("_metadata.file_path").distinct().collect()}


def test_untouched_buckets_keep_their_files(spark, table):
    table.upsert(batch(spark, *[(f"k{i}", "1", 1) for i in range(200)]), "seq")
    before = files_of(table)
    table.upsert(batch(spark, ("k7", "2", 1)), "seq")
    assert len(before - files_of(table)) == 1
    middle = files_of(table)
    table.delete_where(c("k") == "k9")
    assert len(middle - files_of(table)) == 1
    assert table.current().count() == 199


def test_a_bucket_without_rows_is_gone(spark, table):
    table.upsert(batch(spark, ("a", "1", 1), ("b", "2", 1), ("c", "3", 1)), "seq")
    table.delete_keys(batch(spark, ("a", "", 1), ("nobody", "", 1)))
    assert rows(table.current()) == [("b", "2"), ("c", "3")]
    table.delete_where(F.lit(True))
    assert rows(table.current()) == [] and files_of(table) == set()
    table.upsert(batch(spark, ("a", "9", 1)), "seq")
    assert rows(table.current()) == [("a", "9")]


def test_delete_keeps_rows_the_condition_does_not_know(spark, table):
    table.upsert(batch(spark, ("a", "gone", 1), ("b", None, 1), ("c", "kept", 1)), "seq")
    table.delete_where(c("v") == "gone")
    assert rows(table.current()) == [("b", None), ("c", "kept")]
    table.clear()
    assert rows(table.current()) == []


def test_corrections_only_touch_changed_rows(spark):
    desk = spark.createDataFrame([("1", "a"), ("2", None), ("3", "c")], "notice_id string, v string")
    edits = spark.createDataFrame([("1", "a"), ("2", "b"), ("9", "x")], "notice_id string, v string")
    changed = tb.changed_rows(desk, edits, ["v"])
    assert rows(changed.select("notice_id", "v")) == [("2", "b")]
    fixed = tb.apply_corrections(desk, changed.select("notice_id", "v"), ["v"])
    assert rows(fixed) == [("1", "a"), ("2", "b"), ("3", "c")]


def test_cascade_erasure_leaves_no_trace_but_the_token(spark):
    people = spark.createDataFrame([("id-1", "A", "d", "X"), ("id-2", "B", "d", "X")], tb.DEMOGRAPHICS)
    seen = spark.createDataFrame([("id-1", "p", AS_OF), ("id-1", "q", AS_OF), ("id-2", "r", AS_OF)], tb.OBSERVATIONS)
    events, seen2, people2 = tb.cascade_erase(people, seen, people.filter("abha_id = 'id-1'"), AS_OF)
    assert [x["abha_id"] for x in seen2.collect()] == ["id-2"]
    assert [x["abha_id"] for x in people2.collect()] == ["id-2"]
    assert "id-1" not in str(events.collect()) and events.count() == 1


def test_corrections_can_set_null(spark):
    desk = spark.createDataFrame([("1", "a", "p"), ("2", "b", "q")], "notice_id string, v string, w string")
    edits = spark.createDataFrame(
        [("1", None, None, ["v"], 2), ("1", "x", "y", ["v", "w"], 1), ("2", None, "z", ["w"], 1), (None, "n", "n", ["v"], 1)],
        "notice_id string, v string, w string, given array<string>, seq int",
    )
    fixed = tb.apply_corrections(desk, edits, ["v", "w"], "notice_id", ("seq",), "given")
    assert rows(fixed) == [("1", None, "p"), ("2", "b", "z")]


def test_a_correction_batch_given_twice_counts_once(spark):
    root = new_folder(spark, "desk")
    record = ("A", None, "Patient with asthma, prescribed salbutamol.", 100.0, "ACTIVE", "N1", "2026-06-30", "Treatment")
    columns = "patient_name string, abha_id string, clinical_payload string, bill_amount double, consent_status string, notice_id string, notice_date string, data_purpose string"
    patients = tb.KeyedTable(spark, f"{root}/patients", tb.PATIENTS, "notice_id")
    patients.upsert(tb.to_stored(flows.gate_intake(spark.createDataFrame([record], columns)), AS_OF))
    edits = spark.createDataFrame(
        [("N1", "22-0000-0000-0000", 1), ("N1", "22-1234-5678-9012", 2)], "notice_id string, abha_id string, seq int"
    )
    for _ in range(2):
        flows.correct(patients, edits, "IDENTITY", AS_OF, root, "b1", "seq")
        assert [r.abha_id for r in patients.current().collect()] == ["22-1234-5678-9012"]
        assert spark.read.parquet(f"{root}/audit").count() == 1


def test_stream_keeps_bad_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(
        '{"Notice_ID": "N1", "Patient_Name": "A"}\n{broken\n{"patient_name": "keyless"}\n'
    )
    root = new_folder(spark, "stream")
    patients = tb.KeyedTable(spark, f"{root}/patients", tb.PATIENTS, "notice_id")
    intake_stream(spark, str(tmp_path / "in"), patients, f"{root}/audit", f"{root}/checkpoint", AS_OF).awaitTermination()
    assert rows(patients.current().select("notice_id", "patient_name")) == [("N1", "A")]
    bad = spark.read.parquet(f"{root}/audit-rejects").select("text", "reason").collect()
    assert sorted(r.reason for r in bad) == ["no JSON record", "no key"]
    assert "{broken" in {r.text for r in bad}


def test_audit_trail_appends(spark):
    path = new_folder(spark, "audit")
    one = spark.createDataFrame([("x",)], "t string")
    for _ in range(2):
        tb.append_audit(
            tb.audit_events(one, AS_OF, F.lit("E"), c("t"), F.lit("R"), F.lit("A")), path
        )
    assert spark.read.parquet(path).count() == 2


def test_pillars(spark):
    df = spark.createDataFrame([("1", "m", 2.0)], "k string, med_name string, price double")
    from wardgate.functions.vocab import PILLAR_OF_COLUMN

    routed = tb.route_pillars(df, "k", PILLAR_OF_COLUMN)
    assert routed["Medications"].columns == ["k", "med_name"]
    assert routed["Insurance"].columns == ["k", "price"]


VERSIONS = T.StructType([T.StructField("seq", T.IntegerType())])


def test_batches_give_one_table_in_any_order(spark):
    batches = [
        [("a", "1", 1), ("b", "1", 1), (None, "x", 1)],
        [("a", "2", 2), ("c", "2", 2)],
        [("a", "3", 3), ("b", "3", 3), ("b", "late", 0), (None, "x", 3)],
    ]
    seen = set()
    for order in ([0, 1, 2], [2, 1, 0], [1, 2, 0], [2, 0, 2, 1, 0]):
        t = tb.KeyedTable(spark, new_folder(spark, "v"), SCHEMA, "k", versions=VERSIONS)
        for i in order:
            t.upsert(batch(spark, *batches[i]))
        seen.add(str([x for x in rows(t.current()) if x[0]]))
    assert seen == {str([("a", "3"), ("b", "3"), ("c", "2")])}


class Lost(Exception):
    pass


def crashing(monkeypatch, step):
    """Makes the step-th change of the file system from now on fail, before it is made."""
    from wardgate import workspace

    real, count = workspace._fs, [0]

    class Fs:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            if name in ("rename", "delete", "create", "mkdirs"):
                count[0] += 1
                if count[0] == step:
                    raise Lost
            return getattr(self.fs, name)

    def fs_of(spark, path):
        fs, p = real(spark, path)
        return Fs(fs), p

    monkeypatch.setattr(workspace, "_fs", fs_of)
    return count


@pytest.mark.parametrize("step", range(1, 12))
def test_a_writer_lost_at_any_step_leaves_the_old_or_the_new_table(spark, monkeypatch, step):
    t = tb.KeyedTable(spark, new_folder(spark, "crash"), SCHEMA, "k", buckets=3)
    before = [(f"k{i}", "1", 1) for i in range(9)]
    t.upsert(batch(spark, *before))
    change = batch(spark, ("k1", "2", 2), ("k2", "2", 2), ("k5", "2", 2))
    with monkeypatch.context() as m:
        crashing(m, step)
        try:
            t.upsert(change)
        except Lost:
            pass
    old, new = [(k, x) for k, x, _ in before], [(k, "2" if k in ("k1", "k2", "k5") else x) for k, x, _ in before]
    assert rows(t.current()) in (old, new)
    t.upsert(change)
    assert rows(t.current()) == new


@pytest.mark.parametrize("step", [1, 2, 3, 4, 5, 6, 8, 10])
def test_an_erasure_lost_at_any_step_is_finished_by_giving_it_again(spark, monkeypatch, step):
    vault = tb.Vault(spark, new_folder(spark, "vault"), buckets=3)
    records = lambda *ids: spark.createDataFrame(
        [(f"id{i}", f"P{i}", "2026-01-01", "ACTIVE", f"seen {i}") for i in ids],
        "abha_id string, patient_name string, notice_date string, consent_status string, clinical_payload string",
    )
    vault.store(records(1, 2, 3, 4), AS_OF, "b1")
    vault.store(records(2, 3, 5), AS_OF, "b2")
    gone = records(2, 4)
    with monkeypatch.context() as m:
        crashing(m, step)
        try:
            vault.erase(gone, AS_OF, "e1")
        except Lost:
            pass
    kept = {x["abha_id"] for x in vault.observations().collect()} & {"id1", "id3", "id5"}
    assert kept == {"id1", "id3", "id5"}
    vault.erase(gone, AS_OF, "e1")
    assert sorted(x["abha_id"] for x in vault.observations().collect()) == ["id1", "id3", "id3", "id5"]
    assert sorted(x["abha_id"] for x in vault.people.current().collect()) == ["id1", "id3", "id5"]
    assert vault.events().count() == 2


def test_erasing_leaves_the_buckets_of_other_ids(spark):
    held = tb.BatchedRows(spark, new_folder(spark, "obs"), tb.OBSERVATIONS, "abha_id", buckets=8)
    some = spark.createDataFrame([(f"id{i}", "p", AS_OF) for i in range(60)], tb.OBSERVATIONS)
    held.store(some, "b1")
    held.store(some, "b1")
    assert held.current().count() == 60
    before = files_of(held)
    held.delete_keys(spark.createDataFrame([("id7",), ("nobody",)], "abha_id string"))
    assert len(before - files_of(held)) == 1 and held.current().count() == 59
    held.store(some.filter("abha_id = 'id3'"), "b1")
    assert [x["abha_id"] for x in held.current().collect()] == ["id3"]


def test_trails_of_both_layouts_are_read_together(spark):
    path = new_folder(spark, "trail")
    events = tb.audit_events(spark.createDataFrame([("x",)], "t string"), AS_OF, F.lit("E"), c("t"), F.lit("R"), F.lit("A"))
    tb.write_audit(events, path, "b1")
    tb.append_audit(events, path)
    assert tb.read_audit(spark, path).count() == 2


def test_a_kept_tally_equals_a_recount(spark, monkeypatch):
    schema = T.StructType([*SCHEMA.fields, T.StructField("m", T.DoubleType())])
    tally = tb.Tally(["v"], {"total": "m"})
    t = tb.KeyedTable(spark, new_folder(spark, "tally"), schema, "k", buckets=3, tally=tally)
    made = lambda *data: spark.createDataFrame(list(data), "k string, v string, m double")

    def same():
        assert rows(tally.shown(t.tallied())) == rows(tally.shown(tally.of(t.current())))

    same()
    first = made(*[(f"k{i}", "ab"[i % 2], i + 0.25) for i in range(20)], (None, "a", 1.0), ("n", None, None))
    for change in (first, first, made(("k1", "a", 7.5), ("new", "c", None)), made(("k1", "b", 7.5), ("new", "a", 0.1))):
        t.upsert(change)
        same()
    t.delete_keys(made(("k1", "", 0.0), ("k2", "", 0.0)))
    same()
    t.delete_where(c("v") == "b")
    same()
    t.compact()
    same()
    for step in (2, 4, 6):  # a lost writer
        with monkeypatch.context() as m:
            crashing(m, step)
            try:
                t.upsert(made((f"s{step}", "z", 2.0), ("k4", "z", 3.0)))
            except Lost:
                pass
        same()
    late = tb.KeyedTable(spark, t.root, schema, "k", buckets=3)
    late.upsert(made(("x", "y", 1.0)))  # without the tally: it must not be trusted afterwards
    t.clear()
    same()


def test_bundles_never_hold_more_than_asked(spark):
    import json

    from wardgate.sinks import fhir_export

    entries = spark.range(57).select(
        F.concat(F.lit("u"), F.col("id") % 50).alias("full_url"), F.concat(F.lit('{"n":'), F.col("id") % 50, F.lit("}")).alias("resource")
    )
    chunk = F.when(c("full_url") != "u1", F.lit(7))
    got = fhir_export.bundles(entries, chunk, "full_url", "collection", most=10).collect()
    sizes = [len(json.loads(r["bundle"])["entry"]) for r in got]
    assert sum(sizes) == 57 and max(sizes) == 10 and len({(r["bundle_id"], r["part"]) for r in got}) == len(got) == 7
    pairs = spark.range(9).select(
        F.concat(F.lit("n"), "id").alias("notice_id"), F.inline(F.expr("array(struct(1 AS seq, '{}' AS resource, 'A' AS url), struct(2 AS seq, '{}' AS resource, 'B' AS url))"))
    )
    got = fhir_export.bundles(pairs, F.lit(0), "notice_id", "transaction", most=4).collect()
    urls = [[e["request"]["url"] for e in json.loads(r["bundle"])["entry"]] for r in got]
    assert sorted(map(len, urls)) == [2, 8, 8] and all(u == ["A", "B"] * (len(u) // 2) for u in urls)

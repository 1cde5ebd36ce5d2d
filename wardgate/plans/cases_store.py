"""Queries over stored tables: upsert, correction, delete, audit, vault, pillars, incremental intake."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardgate.functions import privacy as p
from wardgate.functions import rules as r
from wardgate.operators import dispositions as d
from wardgate.operators import metrics
from wardgate.operators import tables as tb
from wardgate.plans import flows
from wardgate.plans import sql_rules as q
from wardgate.plans.fixtures import fixture, with_fixtures
from wardgate.plans.registry import AS_OF, query
from wardgate.sources.files import accepted_and_rejected
from wardgate.streaming.incremental import LANDED, intake_stream
from wardgate.workspace import new_folder

c = F.col
S = q.STORED_COLUMNS
GATED = with_fixtures("intake", gated=q.gated())
UPSERTED = with_fixtures(
    "intake",
    "batch2",
    gated=q.gated(),
    gated2=q.gated("batch2"),
    last2="""SELECT * FROM gated2 QUALIFY row_number() OVER (PARTITION BY notice_id
        ORDER BY arrival_seq DESC) = 1""",
    stored=f"""SELECT {S} FROM gated WHERE notice_id NOT IN (SELECT notice_id FROM last2)
        UNION ALL SELECT {S} FROM last2""",
)


def _columns(df):
    return df.select(*[x.strip() for x in S.split(",")])


def _stored(spark, sf, name="intake", *extra):
    return tb.to_stored(d.apply_gate(fixture(spark, sf, name)), AS_OF, *extra)


def _patients(spark, label):
    return tb.KeyedTable(spark, new_folder(spark, label), tb.PATIENTS, "notice_id")


def _loaded(spark, sf, label):
    """A table that took in the first batch and then the second."""
    patients = _patients(spark, label)
    patients.upsert(_stored(spark, sf))
    patients.upsert(_stored(spark, sf, "batch2", "arrival_seq"), "arrival_seq")
    return patients


@query("K1_upsert", UPSERTED + f"SELECT {S} FROM stored")
def k1(spark, sf):
    second = _stored(spark, sf, "batch2", "arrival_seq")
    return _columns(tb.upsert(_stored(spark, sf), second, "notice_id", "arrival_seq"))


@query("K1_upsert_table", UPSERTED + f"SELECT {S} FROM stored")
def k1_table(spark, sf):
    return _columns(_loaded(spark, sf, "k1").current())


@query("K1_compacted_table", UPSERTED + f"SELECT {S} FROM stored")
def k1_compacted(spark, sf):
    patients = _loaded(spark, sf, "k1c")
    patients.compact()
    return _columns(patients.current())


@query(
    "A1_kept_summary",
    UPSERTED
    + """SELECT ingest_status, status_reason, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(bill_amount AS DECIMAL(18, 2))) AS DOUBLE) AS bill_total
        FROM stored WHERE NOT coalesce(status_reason = 'CONSENT_REVOKED' AND bill_amount > 5000, false) GROUP BY ALL""",
)
def a1_kept(spark, sf):
    """The disposition summary kept up over two batches, a replay and a delete, without reading the table."""
    patients = tb.KeyedTable(spark, new_folder(spark, "a1k"), tb.PATIENTS, "notice_id", tally=metrics.DISPOSITIONS)
    patients.upsert(_stored(spark, sf))
    for _ in range(2):
        patients.upsert(_stored(spark, sf, "batch2", "arrival_seq"), "arrival_seq")
    patients.delete_where((c("status_reason") == "CONSENT_REVOKED") & (c("bill_amount") > 5000))
    return metrics.kept_summary(patients).withColumn("bill_total", c("bill_total").cast("double"))


CORRECTED = with_fixtures(
    "intake",
    "corrections",
    gated=q.gated(),
    corrected="""SELECT g.* REPLACE (coalesce(x.abha_id, g.abha_id) AS abha_id,
        coalesce(x.clinical_payload, g.clinical_payload) AS clinical_payload,
        coalesce(x.bill_amount, g.bill_amount) AS bill_amount)
        FROM gated g LEFT JOIN corrections x USING (notice_id)""",
)
EDITABLE = ["abha_id", "clinical_payload", "bill_amount"]


@query("K2_corrected_rows", CORRECTED + f"SELECT {S} FROM corrected")
def k2(spark, sf):
    edits = fixture(spark, sf, "corrections")
    return _columns(tb.apply_corrections(_stored(spark, sf), edits, EDITABLE))


@query(
    "K3_delete_by_status",
    UPSERTED + f"SELECT {S} FROM stored WHERE coalesce(ingest_status <> 'PURGED', true)",
)
def k3_status(spark, sf):
    patients = _loaded(spark, sf, "k3a")
    patients.delete_where(c("ingest_status") == "PURGED")
    return _columns(patients.current())


@query(
    "K3_delete_by_reason",
    UPSERTED + f"SELECT {S} FROM stored WHERE coalesce(status_reason <> 'CONSENT_REVOKED', true)",
)
def k3_reason(spark, sf):
    patients = _loaded(spark, sf, "k3b")
    patients.delete_where(c("status_reason") == "CONSENT_REVOKED")
    return _columns(patients.current())


PURGE_AUDIT = GATED + f"""SELECT 'RULE_8_PURGE' AS event_type,
    CASE WHEN abha_id = '' THEN '****' ELSE {q.token('abha_id')} END AS target_token,
    'DPDP Rule 8' AS compliance_rule, 'Targeted Purge of Revoked Records' AS operator_action,
    {q.AS_OF} AS event_ts FROM gated WHERE status_reason = 'CONSENT_REVOKED'"""


def _purge_events(gated):
    return tb.audit_events(
        gated.filter(c("status_reason") == "CONSENT_REVOKED"),
        AS_OF,
        F.lit("RULE_8_PURGE"),
        p.id_token(c("abha_id")),
        F.lit("DPDP Rule 8"),
        F.lit("Targeted Purge of Revoked Records"),
    )


@query(
    "K4_reset_tables",
    f"""SELECT CAST(0 AS BIGINT) AS patients, CAST(count(*) AS BIGINT) AS events
        FROM ({PURGE_AUDIT}) t""",
)
def k4(spark, sf):
    """Table and trail are emptied, then the trail begins anew."""
    folder = new_folder(spark, "k4")
    gated = d.apply_gate(fixture(spark, sf, "intake"))
    tb.append_audit(_purge_events(gated), folder)
    patients = _loaded(spark, sf, "k4t")
    flows.reset(patients, folder)
    tb.append_audit(_purge_events(gated), folder)
    left = patients.current().select(F.lit(1).alias("p"), F.lit(None).cast("int").alias("e"))
    events = spark.read.parquet(folder).select(
        F.lit(None).cast("int").alias("p"), F.lit(1).alias("e")
    )
    return left.unionByName(events).agg(
        F.count("p").alias("patients"), F.count("e").alias("events")
    )


@query(
    "K3_purge_flow",
    UPSERTED
    + """SELECT 'event' AS part, CAST(count(*) AS STRING) || ' Records' AS what FROM stored
            WHERE status_reason = 'CONSENT_REVOKED'
        UNION ALL SELECT 'left', notice_id FROM stored WHERE coalesce(status_reason <> 'CONSENT_REVOKED', true)""",
)
def k3_flow(spark, sf):
    """Delete, then record the event with its number; given twice it is the same."""
    patients = _loaded(spark, sf, "k3f")
    trail = new_folder(spark, "k3f-audit")
    for _ in range(2):
        flows.purge(patients, "CONSENT_REVOKED", AS_OF, trail, "p1")
    events = spark.read.parquet(trail).select(F.lit("event").alias("part"), c("target_token").alias("what"))
    return events.unionByName(patients.current().select(F.lit("left").alias("part"), c("notice_id").alias("what")))


@query(
    "K10_stored_vault_erasure",
    with_fixtures(
        "base",
        demographics="""SELECT abha_id, patient_name, notice_date, consent_status FROM base
        QUALIFY abha_id IS NULL OR row_number() OVER (PARTITION BY abha_id ORDER BY k DESC) = 1""",
        observations="SELECT abha_id, clinical_payload FROM base",
        gone=f"""SELECT DISTINCT abha_id FROM demographics WHERE upper(consent_status) = 'REVOKED'
        OR CAST(notice_date AS TIMESTAMP) < {q.CUTOFF}""",
    )
    + f"""SELECT 'audit' AS part, {q.token('abha_id')} AS key, CAST(1 AS BIGINT) AS n FROM gone
        WHERE abha_id IS NOT NULL
    UNION ALL SELECT 'observations', abha_id, CAST(count(*) AS BIGINT) FROM observations o
        WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.abha_id = o.abha_id) GROUP BY abha_id
    UNION ALL SELECT 'demographics', abha_id, CAST(count(*) AS BIGINT) FROM demographics o
        WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.abha_id = o.abha_id) GROUP BY abha_id""",
)
def k10_stored(spark, sf):
    """The vault stored in two batches, erased by id twice, and all three tables read back."""
    vault = tb.Vault(spark, new_folder(spark, "vault"))
    base = fixture(spark, sf, "base")
    middle = base.agg(F.max("k")).first()[0] // 2
    for name, part in (("a", base.filter(c("k") <= middle)), ("b", base.filter(c("k") > middle))):
        for _ in range(2):
            vault.store(part, AS_OF, name, "k")
    for _ in range(2):
        judged = d.apply_retention_policy(vault.people.current(), AS_OF)
        vault.erase(judged.filter(c("evaluation") == "PURGE_REQUIRED"), AS_OF, "e1")

    def per_key(df, part, key):
        return df.groupBy(c(key).alias("key")).agg(F.count("*").alias("n")).withColumn("part", F.lit(part))

    audit = vault.events().select(c("target_token").alias("key"), F.lit(1).cast("bigint").alias("n"), F.lit("audit").alias("part"))
    return audit.unionByName(per_key(vault.observations(), "observations", "abha_id")).unionByName(
        per_key(vault.people.current(), "demographics", "abha_id")
    )


@query("K5_audit_append", PURGE_AUDIT)
def k5(spark, sf):
    folder = new_folder(spark, "k5")
    tb.append_audit(_purge_events(d.apply_gate(fixture(spark, sf, "intake"))), folder)
    return spark.read.parquet(folder).select(*tb.AUDIT_COLUMNS)


@query(
    "K5_ledger_line",
    with_fixtures("intake", erased=q.ERASED)
    + f"""SELECT notice_id, '[1998-07-01T12:00:00] [GOVERNANCE] PURGE on ' ||
        {q.redact("coalesce(abha_id, 'UNKNOWN')")} || ': ' || erasure_reason || ' -> ' || outcome AS line
        FROM erased""",
)
def k5_ledger(spark, sf):
    out = d.apply_erasure_policy(fixture(spark, sf, "intake"), AS_OF)
    line = p.ledger_line(
        r.moment(AS_OF), F.lit("PURGE"), F.coalesce("abha_id", F.lit("UNKNOWN")),
        c("erasure_reason"), c("outcome"),
    )
    return out.select("notice_id", line.alias("line"))


VAULT = with_fixtures(
    "base",
    demographics="""SELECT abha_id, patient_name, notice_date, consent_status FROM base
        QUALIFY abha_id IS NULL OR row_number() OVER (PARTITION BY abha_id ORDER BY k DESC) = 1""",
    observations="SELECT abha_id, clinical_payload FROM base",
)


@query(
    "K9_vault_demographics",
    VAULT + "SELECT * FROM demographics",
)
def k9_people(spark, sf):
    return tb.split_vault(fixture(spark, sf, "base"), AS_OF, "k")[0]


@query(
    "K9_vault_observations",
    VAULT + f"SELECT *, {q.AS_OF} AS ingest_ts FROM observations",
)
def k9_payloads(spark, sf):
    return tb.split_vault(fixture(spark, sf, "base"), AS_OF, "k")[1]


@query(
    "N4_vault_join",
    VAULT
    + f"""SELECT d.*, o.clinical_payload, {q.AS_OF} AS ingest_ts FROM demographics d
        JOIN observations o ON d.abha_id = o.abha_id""",
)
def n4(spark, sf):
    return tb.join_vault(*tb.split_vault(fixture(spark, sf, "base"), AS_OF, "k"))


GONE = f"""SELECT DISTINCT abha_id FROM demographics WHERE upper(consent_status) = 'REVOKED'
    OR CAST(notice_date AS TIMESTAMP) < {q.CUTOFF}"""


@query(
    "K10_cascade_erasure",
    VAULT.rstrip()
    + f""", gone AS ({GONE})
    SELECT 'audit' AS part, {q.token('abha_id')} AS key, CAST(1 AS BIGINT) AS n FROM gone
        WHERE abha_id IS NOT NULL
    UNION ALL SELECT 'observations', abha_id, CAST(count(*) AS BIGINT) FROM observations o
        WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.abha_id = o.abha_id) GROUP BY abha_id
    UNION ALL SELECT 'demographics', abha_id, CAST(count(*) AS BIGINT) FROM demographics o
        WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.abha_id = o.abha_id) GROUP BY abha_id""",
)
def k10(spark, sf):
    people, payloads = tb.split_vault(fixture(spark, sf, "base"), AS_OF, "k")
    doomed = d.apply_retention_policy(people, AS_OF).filter(c("evaluation") == "PURGE_REQUIRED")
    events, payloads, people = tb.cascade_erase(
        people, payloads, doomed.filter(c("abha_id").isNotNull()), AS_OF
    )

    def per_key(df, part, key):
        return df.groupBy(c(key).alias("key")).agg(F.count("*").alias("n")).withColumn(
            "part", F.lit(part)
        )

    audit = events.select(
        c("target_token").alias("key"), F.lit(1).cast("bigint").alias("n"), F.lit("audit").alias("part")
    )
    return audit.unionByName(per_key(payloads, "observations", "abha_id")).unionByName(
        per_key(people, "demographics", "abha_id")
    )


# Where each intake column goes.
PILLARS = {
    "patient_name": "Demographics",
    "abha_id": "Demographics",
    "clinical_payload": "Observations",
    "bill_amount": "Finance",
    "consent_status": "Governance",
    "notice_date": "Governance",
    "data_purpose": "Governance",
}


@query(
    "K11_pillar_routing",
    with_fixtures("intake")
    + """SELECT 'Demographics' AS pillar, notice_id, coalesce(patient_name, '') || '|' ||
            coalesce(abha_id, '') AS row FROM intake
        UNION ALL SELECT 'Observations', notice_id, coalesce(clinical_payload, '') FROM intake
        UNION ALL SELECT 'Finance', notice_id, CAST(bill_amount AS STRING) FROM intake
        UNION ALL SELECT 'Governance', notice_id, coalesce(consent_status, '') || '|' ||
            coalesce(notice_date, '') || '|' || coalesce(data_purpose, '') FROM intake""",
)
def k11(spark, sf):
    routed = tb.route_pillars(fixture(spark, sf, "intake"), "notice_id", PILLARS)
    out = None
    for name, df in routed.items():
        parts = [F.coalesce(c(x).cast("string"), F.lit("")) for x in df.columns if x != "notice_id"]
        flat = df.select(F.lit(name).alias("pillar"), "notice_id", F.concat_ws("|", *parts).alias("row"))
        out = flat if out is None else out.unionByName(flat)
    return out


# --- corrections ------------------------------------------------------------------------------


@query(
    "N5_identity_desk_changes",
    with_fixtures("intake", "corrections", gated=q.gated())
    + """SELECT notice_id, x.abha_id, g.abha_id AS old_id FROM corrections x JOIN gated g USING (notice_id)
        WHERE g.status_reason = 'MISSING_ABHA' AND x.abha_id IS DISTINCT FROM g.abha_id""",
)
def n5_identity(spark, sf):
    desk = d.apply_gate(fixture(spark, sf, "intake")).filter(c("status_reason") == "MISSING_ABHA")
    changed = tb.changed_rows(desk, fixture(spark, sf, "corrections"), ["abha_id"])
    return changed.select("notice_id", "abha_id", c("_old_abha_id").alias("old_id"))


@query(
    "N5_clinical_desk_changes",
    with_fixtures("intake", "corrections", gated=q.gated())
    + """SELECT notice_id, x.clinical_payload, x.bill_amount FROM corrections x
        JOIN gated g USING (notice_id) WHERE g.status_reason = 'PENDING_CLINICAL_AUDIT'
        AND (x.clinical_payload IS DISTINCT FROM g.clinical_payload OR x.bill_amount <> g.bill_amount)""",
)
def n5_clinical(spark, sf):
    gated = d.apply_gate(fixture(spark, sf, "intake"))
    desk = gated.filter(c("status_reason") == "PENDING_CLINICAL_AUDIT")
    edits = fixture(spark, sf, "corrections")
    changed = tb.changed_rows(desk, edits, ["clinical_payload", "bill_amount"])
    return changed.select("notice_id", "clinical_payload", "bill_amount")


@query(
    "V17_correction_loop",
    CORRECTED.rstrip()
    + f""", regated AS ({q.gated("(SELECT * EXCLUDE (abha_valid, surgical_truth, status_reason, ingest_status) FROM corrected)")})
        SELECT {S} FROM regated""",
)
def v17_loop(spark, sf):
    """Desk edits, corrected, gated again and upserted: only changed rows are touched."""
    stored = _stored(spark, sf)
    edits = fixture(spark, sf, "corrections")
    changed = tb.changed_rows(stored, edits, EDITABLE).select("notice_id", *EDITABLE)
    touched = stored.join(changed.select("notice_id"), "notice_id", "left_semi")
    again = d.apply_gate(tb.apply_corrections(touched, changed, EDITABLE))
    return _columns(tb.upsert(stored, tb.to_stored(again, AS_OF), "notice_id"))


@query(
    "N8_semi_and_anti",
    with_fixtures("intake", "batch2")
    + """SELECT notice_id, notice_id IN (SELECT notice_id FROM batch2) AS replaced FROM intake""",
)
def n8(spark, sf):
    intake, keys = fixture(spark, sf, "intake"), fixture(spark, sf, "batch2").select("notice_id")
    hit = intake.join(keys, "notice_id", "left_semi").select("notice_id", F.lit(True).alias("replaced"))
    miss = intake.join(keys, "notice_id", "left_anti").select("notice_id", F.lit(False).alias("replaced"))
    return hit.unionByName(miss)


# --- reading back -----------------------------------------------------------------------------


@query(
    "S14_read_back",
    UPSERTED
    + """SELECT notice_id AS "Notice_ID", abha_id AS "ABHA_ID", patient_name AS "Patient_Name",
        notice_date AS "Notice_Date", consent_status AS "Consent_Status",
        clinical_payload AS "Clinical_Payload", bill_amount AS "Bill_Amount",
        CAST(NULL AS STRING) AS "Validated_ICD10", surgical_truth AS "SURGICAL_TRUTH",
        ingest_status AS "Ingest_Status", status_reason AS "Status_Reason" FROM stored""",
)
def s14(spark, sf):
    return tb.as_canonical(_loaded(spark, sf, "s14").current()).drop("ingest_ts")


@query(
    "S15_final_validated",
    UPSERTED + f"SELECT {S} FROM stored WHERE status_reason <> 'CONSENT_REVOKED'",
)
def s15(spark, sf):
    return _columns(d.final_validated(_loaded(spark, sf, "s15").current()))


@query(
    "S16_accepted_and_rejected",
    with_fixtures("base")
    + """SELECT k AS doc_id, CASE WHEN k % 31 = 0 THEN 'rejected' ELSE 'accepted' END AS lane,
        CASE WHEN k % 31 <> 0 THEN notice_id END AS notice_id FROM base""",
)
def s16(spark, sf):
    good, bad = accepted_and_rejected(fixture(spark, sf, "json_lines"))
    lanes = bad.select("doc_id", F.lit("rejected").alias("lane"), F.lit(None).cast("string").alias("notice_id"))
    return good.select("doc_id", F.lit("accepted").alias("lane"), "notice_id").unionByName(lanes)


# --- incremental intake -----------------------------------------------------------------------


def _streamed(spark, sf, label):
    """Land the whole intake as files in two drops and take them in by stream."""
    root = new_folder(spark, label)
    lines = fixture(spark, sf, "intake").select(
        *[c(f.name).cast("string") if f.name == "bill_amount" else c(f.name) for f in LINES]
    )
    patients = tb.KeyedTable(spark, f"{root}/patients", tb.PATIENTS, "notice_id", versions=LANDED)
    half = F.right("notice_id", F.lit(1)).cast("int") % 2
    for drop in (0, 1):
        lines.filter(half == drop).write.mode("append").json(f"{root}/landing")
        intake_stream(
            spark, f"{root}/landing", patients, f"{root}/audit", f"{root}/checkpoint", AS_OF
        ).awaitTermination()
    return patients, f"{root}/audit"


LINES = T.StructType(
    [
        T.StructField(x, T.StringType())
        for x in (
            "patient_name", "abha_id", "clinical_payload", "bill_amount", "consent_status",
            "notice_id", "notice_date", "data_purpose",
        )
    ]
)


@query("T1_incremental_intake", GATED + f"SELECT {S} FROM gated")
def t1(spark, sf):
    return _columns(_streamed(spark, sf, "t1")[0].current())


@query(
    "T1_incremental_audit",
    with_fixtures("base")
    + """SELECT 'INTAKE' AS event_type, CAST(count(*) AS STRING) || ' Records' AS target_token
        FROM base GROUP BY CAST(right(notice_id, 1) AS INT) % 2""",
)
def t1_audit(spark, sf):
    audit = spark.read.parquet(_streamed(spark, sf, "t1a")[1])
    return audit.select("event_type", "target_token")

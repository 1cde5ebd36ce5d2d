"""Queries over naming, cleaning, header mapping, identity, ranking, sampling and generation."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardgate.functions import rules as r
from wardgate.functions import text as t
from wardgate.functions import vocab as v
from wardgate.operators import aliases as al
from wardgate.operators import identity, naming, sampling
from wardgate.operators import tables as tb
from wardgate.plans import sql_rules as q
from wardgate.plans.fixtures import fixture, table, with_fixtures
from wardgate.plans.registry import AS_OF, query

c = F.col
INTAKE = with_fixtures("intake")


# --- P: naming and cleaning -------------------------------------------------------------------


@query(
    "P1_canonical_rename",
    INTAKE
    + """SELECT patient_name, abha_id, clinical_payload, bill_amount, CAST(NULL AS STRING)
        AS consent_status, notice_id, notice_date, CAST(NULL AS STRING) AS data_purpose FROM intake""",
)
def p1(spark, sf):
    messy = fixture(spark, sf, "intake").select(
        c("patient_name").alias("PATIENT_NAME"),
        c("abha_id").alias("Abha_Id"),
        c("clinical_payload").alias("Clinical_Payload"),
        c("bill_amount").cast("string").alias("BILL_amount"),
        c("notice_id").alias("Notice_ID"),
        c("notice_date").alias("notice_DATE"),
    )
    return naming.canonical_rename(messy)


MESSY_V1 = """patient_name AS "PT_NAME", abha_id AS "ABHA Number", clinical_payload AS "Diagnosis",
    consent_status AS "Status", notice_id AS "Doc_ID", notice_date AS "Date" """


def _messy_v1(df):
    names = {
        "patient_name": "PT_NAME",
        "abha_id": "ABHA Number",
        "clinical_payload": "Diagnosis",
        "consent_status": "Status",
        "notice_id": "Doc_ID",
        "notice_date": "Date",
    }
    return df.withColumnsRenamed(names)


@query(
    "P2_synonym_rename",
    INTAKE
    + """SELECT patient_name, abha_id, clinical_payload, consent_status, notice_id, notice_date,
        bill_amount, CAST(NULL AS STRING) AS data_purpose FROM intake""",
)
def p2(spark, sf):
    return naming.synonym_rename(_messy_v1(fixture(spark, sf, "intake").drop("data_purpose")))


@query(
    "P4_mapping_override",
    INTAKE
    + """SELECT patient_name, abha_id, clinical_payload, consent_status, notice_id, notice_date,
        data_purpose FROM intake""",
)
def p4(spark, sf):
    odd = fixture(spark, sf, "intake").drop("bill_amount").withColumnsRenamed(
        {"notice_id": "Slip", "patient_name": "Who"}
    )
    return naming.synonym_rename(odd, overrides={"Slip": "notice_id", "who": "patient_name"})


def _alias_values() -> str:
    rows = ", ".join(f"({q.lit(a)}, {q.lit(f)}, {o})" for a, f, o in al.alias_rows())
    return f"SELECT * FROM (VALUES {rows}) AS x(alias, canonical, ord)"


HEADERS = with_fixtures("headers", aliases=_alias_values())
HKEY = "replace(replace(lower(trim(column_name)), ' ', '_'), '-', '_')"


@query(
    "P3_alias_resolution",
    HEADERS
    + f"""SELECT source_id, position, column_name, coalesce(a.canonical, b.canonical, column_name)
        AS canonical FROM headers LEFT JOIN aliases a ON lower(trim(column_name)) = a.alias
        LEFT JOIN aliases b ON {HKEY} = b.alias""",
)
def p3(spark, sf):
    return al.resolve_headers(fixture(spark, sf, "headers"))


def _similarity_sql(a: str, b: str) -> str:
    def overlap(sep: str) -> str:
        x, y = f"string_split({a}, '{sep}')", f"string_split({b}, '{sep}')"
        both = f"len(list_intersect({x}, {y}))"
        return f"{both} / len(list_distinct(list_concat({x}, {y})))"

    return f"""CASE WHEN {a} = {b} THEN 1.0::DOUBLE
        WHEN contains({a}, {b}) OR contains({b}, {a}) THEN 0.8::DOUBLE
        ELSE {overlap('')} * 0.5::DOUBLE + {overlap('_')} * 0.5::DOUBLE END"""


@query(
    "P5_similarity",
    f"""SELECT p_partkey, {_similarity_sql('a', 'b')} AS score FROM (SELECT p_partkey,
        lower(replace(p_name, ' ', '_')) AS a, lower(p_type) AS b FROM part) t""",
)
def p5(spark, sf):
    parts = table(spark, sf, "part")
    score = t.similarity(F.replace("p_name", F.lit(" "), F.lit("_")), c("p_type"))
    return parts.select("p_partkey", score.alias("score"))


SCORES = (
    HEADERS.rstrip()
    + f""",
    fields AS (SELECT canonical, row_number() OVER (ORDER BY min(ord)) - 1 AS field_ord
        FROM aliases GROUP BY canonical),
    scored AS (SELECT column_name, canonical, alias, ord, {_similarity_sql('h', 'alias')} AS score
        FROM (SELECT column_name, {HKEY} AS h
            FROM (SELECT DISTINCT column_name FROM headers) d WHERE column_name <> '') n, aliases),
    best AS (SELECT column_name, canonical, field_ord, max(score) AS score,
        arg_max(alias, row(score, -ord)) AS alias
        FROM scored JOIN fields USING (canonical) GROUP BY ALL),
    top AS (SELECT *, CAST(row_number() OVER (PARTITION BY column_name
        ORDER BY score DESC, field_ord) AS INT) AS rank FROM best)
    """
)


@query(
    "P6_field_suggestion",
    SCORES
    + """SELECT column_name, max(CASE WHEN rank = 1 THEN canonical END) AS suggested,
        max(CASE WHEN rank = 1 THEN score END) AS score,
        max(CASE WHEN rank = 1 THEN score END) > 0.3 AS accepted,
        max(CASE WHEN rank = 2 THEN canonical END) || ',' || max(CASE WHEN rank = 3 THEN canonical END)
            AS alternatives
        FROM top WHERE rank <= 3 GROUP BY column_name""",
)
def p6(spark, sf):
    return al.suggest_fields(fixture(spark, sf, "headers"))


@query("W1_top_candidates", SCORES + "SELECT column_name, rank, canonical, score, alias FROM top WHERE rank <= 3")
def w1(spark, sf):
    return al.top_candidates(fixture(spark, sf, "headers"))


@query(
    "N7_all_pairs_similarity",
    SCORES
    + """SELECT canonical, CAST(count(*) AS BIGINT) AS headers,
        CAST(sum(CAST(score * 1000000 AS BIGINT)) AS BIGINT) AS score_sum FROM best GROUP BY canonical""",
)
def n7(spark, sf):
    scores = al.top_candidates(fixture(spark, sf, "headers"), k=len(al.FIELD_ORDER))
    return scores.groupBy("canonical").agg(
        F.count("*").alias("headers"),
        F.sum(F.round(c("score") * 1000000).cast("bigint")).alias("score_sum"),
    )


@query(
    "N6_alias_lookup",
    HEADERS
    + f"""SELECT coalesce(a.canonical, b.canonical, 'UNMAPPED') AS canonical, CAST(count(*) AS BIGINT) AS n
        FROM headers LEFT JOIN aliases a ON lower(trim(column_name)) = a.alias
        LEFT JOIN aliases b ON {HKEY} = b.alias GROUP BY ALL""",
)
def n6(spark, sf):
    known = al.canonical_name("column_name")
    return (
        fixture(spark, sf, "headers")
        .groupBy(F.coalesce(known, F.lit("UNMAPPED")).alias("canonical"))
        .agg(F.count("*").alias("n"))
    )


@query(
    "P7_standardize_drop",
    INTAKE
    + """SELECT patient_name, abha_id, clinical_payload, consent_status,
        CAST(NULL AS STRING) AS consent_token, notice_id, notice_date,
        CAST(NULL AS STRING) AS data_purpose FROM intake""",
)
def p7_drop(spark, sf):
    odd = _odd_headers(fixture(spark, sf, "intake"))
    return al.standardize(odd)


def _odd_headers(df):
    """Aliased headers, two unknown ones, and two claiming the notice id (the later one counts)."""
    return df.select(
        F.lit("W-0").alias("Reference No"),
        c("patient_name").alias("Beneficiary Name"),
        c("abha_id").alias("UHID"),
        c("clinical_payload").alias("doctor-notes"),
        c("consent_status").alias("privacy consent"),
        c("notice_id").alias("dpdp notice id"),
        c("notice_date").alias("Issue Date"),
        c("bill_amount").alias("Total Due"),
        F.lit("W1").alias("ward"),
    )


@query(
    "P7_standardize_keep",
    INTAKE
    + """SELECT patient_name, abha_id, clinical_payload, consent_status,
        CAST(NULL AS STRING) AS consent_token, notice_id, notice_date,
        CAST(NULL AS STRING) AS data_purpose, bill_amount AS "UNMAPPED_Total Due",
        'W1' AS "UNMAPPED_ward" FROM intake""",
)
def p7_keep(spark, sf):
    return al.standardize(_odd_headers(fixture(spark, sf, "intake")), unknown="keep")


@query(
    "P8_autofill",
    INTAKE
    + """SELECT patient_name, clinical_payload, 'AUTO_ABHA_ID' AS abha_id, '2026-01-01' AS notice_date,
        'N-2026-AUTO' AS notice_id, 'GRANTED' AS consent_status, 'AUTO_Data_Purpose' AS data_purpose
        FROM intake""",
)
def p8(spark, sf):
    few = fixture(spark, sf, "intake").select("patient_name", "clinical_payload")
    return naming.synonym_rename(few, autofill=True)


AMOUNTS = """CASE WHEN k % 7 = 0 THEN 'n/a' WHEN k % 11 = 0 THEN NULL WHEN k % 13 = 0 THEN '1,200'
    WHEN k % 17 = 0 THEN '' ELSE CAST(CAST(bill_amount AS BIGINT) AS STRING) || '.50' END"""


@query(
    "P9_amount_coercion",
    with_fixtures("base", a=f"SELECT notice_id, {AMOUNTS} AS x FROM base")
    + "SELECT notice_id, coalesce(TRY_CAST(x AS DOUBLE), 0) AS bill_amount FROM a",
)
def p9(spark, sf):
    raw = fixture(spark, sf, "base").select("notice_id", F.expr(AMOUNTS).alias("x"))
    return raw.select("notice_id", t.amount(c("x")).alias("bill_amount"))


@query(
    "P10_canonical_first",
    INTAKE
    + """SELECT notice_id,
        'patient_name,abha_id,clinical_payload,consent_status,notice_id,notice_date,data_purpose,bill_amount'
        AS column_order FROM intake""",
)
def p10(spark, sf):
    shuffled = fixture(spark, sf, "intake").select(
        "bill_amount", "notice_date", "data_purpose", "notice_id", "consent_status",
        "clinical_payload", "abha_id", "patient_name",
    )
    ordered = naming.canonical_first(shuffled)
    return ordered.select("notice_id", F.lit(",".join(ordered.columns)).alias("column_order"))


# Records that lost their id or name, with the report text at hand.
LOST = """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN NULL WHEN doc_id % 7 = 1 THEN ''
        ELSE '00-0000-0000-0000' END AS abha_id,
    CASE doc_id % 4 WHEN 0 THEN 'Unknown/Redacted' WHEN 1 THEN 'AUTO_Patient_Name' WHEN 2 THEN NULL
        ELSE 'Known Person' END AS patient_name,
    body AS clinical_payload FROM reports"""


@query(
    "P11_field_recovery",
    with_fixtures("reports", lost=LOST)
    + f"""SELECT clinical_payload,
        CASE WHEN coalesce(abha_id = '', true) THEN coalesce(replace(nullif(regexp_extract(txt,
            {q.lit(v.RECOVER_ID)}, 0), ''), ' ', '-'), abha_id) ELSE abha_id END AS abha_id,
        CASE WHEN patient_name = 'Known Person' THEN patient_name ELSE coalesce(nullif(regexp_extract(
            txt, {q.lit(v.RECOVER_NAME)}, 1), ''), patient_name) END AS patient_name
        FROM (SELECT *, concat_ws(' ', CAST(doc_id AS STRING), nullif(abha_id, ''),
            nullif(patient_name, ''), clinical_payload) AS txt FROM lost) t""",
)
def p11(spark, sf):
    fixture(spark, sf, "reports").createOrReplaceTempView("reports")
    lost = spark.sql(LOST)
    full = lost.withColumns(
        {f: F.lit(None).cast("string") for f in v.INTAKE_V1_FIELDS if f not in lost.columns}
    )
    return naming.recover_fields(full).select("clinical_payload", "abha_id", "patient_name")


DATES = """CASE k % 5 WHEN 0 THEN 'soon' WHEN 1 THEN NULL WHEN 2 THEN notice_date || ' 10:00'
    ELSE notice_date END"""


@query(
    "P12_strict_date",
    with_fixtures("base", a=f"SELECT notice_id, {DATES} AS x FROM base")
    + f"""SELECT notice_id, coalesce(CASE WHEN length(x) = 10 THEN TRY_CAST(x AS TIMESTAMP) END,
        {q.AS_OF}) AS notice_date FROM a""",
)
def p12(spark, sf):
    raw = fixture(spark, sf, "base").select("notice_id", F.expr(DATES).alias("x"))
    return raw.select("notice_id", r.strict_date(c("x"), AS_OF).alias("notice_date"))


_Y, _M, _D = (f"substring(notice_date, {a}, {n})" for a, n in ((1, 4), (6, 2), (9, 2)))
WRITTEN = f"""CASE k % 8 WHEN 0 THEN {_Y} || '/' || {_M} || '/' || {_D}
    WHEN 1 THEN {_D} || '-' || {_M} || '-' || {_Y} WHEN 2 THEN {_M} || '/' || {_D} || '/' || {_Y}
    WHEN 3 THEN {_Y} || {_M} || {_D} WHEN 4 THEN notice_date || ' 08:30:00' WHEN 5 THEN 'unknown'
    WHEN 6 THEN NULL ELSE notice_date END"""


@query(
    "P13_lenient_date",
    with_fixtures("base", a=f"SELECT notice_id, {WRITTEN} AS x FROM base")
    + """SELECT notice_id, coalesce(try_strptime(x, ['%Y-%m-%d', '%Y-%m-%d %H:%M:%S', '%Y/%m/%d',
        '%Y%m%d', '%m-%d-%Y', '%m/%d/%Y', '%d-%m-%Y', '%d/%m/%Y']), NULL) AS ts FROM a""",
)
def p13(spark, sf):
    raw = fixture(spark, sf, "base").select("notice_id", F.expr(WRITTEN).alias("x"))
    return raw.select("notice_id", r.lenient_timestamp(c("x")).alias("ts"))


TOKENS = "CASE k % 4 WHEN 0 THEN 'nan' WHEN 1 THEN 'None' ELSE patient_name END"


@query(
    "P14_null_tokens",
    with_fixtures("base")
    + """SELECT notice_id, CASE WHEN k % 4 >= 2 THEN patient_name END AS patient_name,
        CAST(CAST(bill_amount AS BIGINT) AS STRING) AS bill FROM base""",
)
def p14(spark, sf):
    raw = fixture(spark, sf, "base").select(
        "notice_id", F.expr(TOKENS).alias("patient_name"), c("bill_amount").cast("bigint").alias("bill")
    )
    return naming.drop_null_tokens(raw)


@query(
    "P15_manual_entry",
    with_fixtures(
        "registry",
        typed="""SELECT patient_name, abha_id, 'Patient diagnosed with asthma, seen ' ||
            CAST(reg_seq AS STRING) || ' times' AS clinical_payload,
            CAST(6000 AS DOUBLE) AS bill_amount, reg_seq FROM registry""",
        full_="""SELECT patient_name, abha_id, clinical_payload, bill_amount, 'ACTIVE' AS consent_status,
            '1998-07-01' AS notice_date, 'Manual Entry' AS data_purpose,
            sha256(patient_name || '|' || abha_id || '|' || clinical_payload || '|6000.0')
                AS notice_id FROM typed""",
        gated=q.gated("full_"),
    )
    + """SELECT notice_id, patient_name, abha_id, notice_date, consent_status, data_purpose,
        ingest_status, status_reason FROM gated""",
)
def p15(spark, sf):
    from wardgate.operators.dispositions import apply_gate

    typed = fixture(spark, sf, "registry").select(
        "patient_name",
        "abha_id",
        F.concat(
            F.lit("Patient diagnosed with asthma, seen "), c("reg_seq").cast("string"), F.lit(" times")
        ).alias("clinical_payload"),
        F.lit(6000.0).alias("bill_amount"),
    )
    return apply_gate(naming.manual_entries(typed, AS_OF)).select(
        "notice_id", "patient_name", "abha_id", "notice_date", "consent_status", "data_purpose",
        "ingest_status", "status_reason",
    )


def _field_of_header() -> str:
    whens = " ".join(
        f"WHEN {q.lit(s)} THEN {q.lit(f)}" for f, names in v.INTAKE_V1_SYNONYMS.items() for s in names
    )
    return f"CASE lower(column_name) {whens} ELSE lower(column_name) END"


@query(
    "P16_mapping_gaps",
    with_fixtures("headers")
    + f"""SELECT s.source_id, f.required_field, g.best_guess
        FROM (SELECT DISTINCT source_id FROM headers) s
        CROSS JOIN (VALUES ('patient_name'), ('abha_id'), ('notice_id')) f(required_field)
        LEFT JOIN (SELECT source_id, r.rf, arg_min(column_name, position) AS best_guess FROM headers,
            (VALUES ('patient_name'), ('abha_id'), ('notice_id')) r(rf)
            WHERE contains(lower(column_name), r.rf) GROUP BY ALL) g
            ON g.source_id = s.source_id AND g.rf = f.required_field
        WHERE NOT EXISTS (SELECT 1 FROM headers h WHERE h.source_id = s.source_id
            AND {_field_of_header()} = f.required_field)""",
)
def p16(spark, sf):
    return al.mapping_gaps(fixture(spark, sf, "headers"))


# --- N: identity ------------------------------------------------------------------------------

# Names shared by very many records stand for the walk-ins nobody asked.
TODO = """SELECT notice_id, CASE WHEN k % 3 = 0 THEN 'Patient_1_1001' ELSE patient_name END
    AS patient_name, abha_id, consent_status FROM base"""
FIRST = """SELECT patient_name, abha_id AS rid, consent_status AS rcs FROM registry WHERE reg_seq = 1"""


@query(
    "N1_registry_recovery",
    with_fixtures("base", "registry", todo=TODO, first=FIRST)
    + """SELECT notice_id, patient_name,
        CASE WHEN t.abha_id IS NOT NULL THEN t.abha_id WHEN f.rid IS NOT NULL THEN f.rid
            ELSE 'ABHA' || lpad(CAST(('0x' || substr(md5(patient_name), 1, 8))::BIGINT % 1000000
                AS STRING), 6, '0') END AS abha_id,
        CASE WHEN t.abha_id IS NULL AND f.rid IS NOT NULL THEN f.rcs ELSE t.consent_status END
            AS consent_status,
        CASE WHEN t.abha_id IS NOT NULL THEN NULL WHEN f.rid IS NOT NULL THEN 'RECOVERED_FROM_DB'
            ELSE 'LINKED_BY_M1' END AS discovery_status
        FROM todo t LEFT JOIN first f USING (patient_name)""",
)
def n1(spark, sf):
    fixture(spark, sf, "base").createOrReplaceTempView("base")
    return identity.resolve_identity(spark.sql(TODO), registry=fixture(spark, sf, "registry"))


@query(
    "N2_link_table",
    with_fixtures("base", "registry", "links", todo=TODO, first=FIRST)
    + """SELECT notice_id, t.patient_name, coalesce(t.abha_id, f.rid, l.abha_id) AS abha_id,
        CASE WHEN t.abha_id IS NULL AND f.rid IS NOT NULL THEN f.rcs ELSE t.consent_status END
            AS consent_status,
        CASE WHEN t.abha_id IS NOT NULL THEN NULL WHEN f.rid IS NOT NULL THEN 'RECOVERED_FROM_DB'
            WHEN l.abha_id IS NOT NULL THEN 'LINKED_BY_GATEWAY' END AS discovery_status
        FROM todo t LEFT JOIN first f ON t.patient_name = f.patient_name
        LEFT JOIN links l ON t.patient_name = l.patient_name""",
)
def n2(spark, sf):
    fixture(spark, sf, "base").createOrReplaceTempView("base")
    return identity.resolve_identity(
        spark.sql(TODO), fixture(spark, sf, "registry"), fixture(spark, sf, "links")
    )


@query(
    "N3_surrogate_id",
    INTAKE
    + """SELECT notice_id, 'ABHA' || lpad(CAST(('0x' || substr(md5(patient_name), 1, 8))::BIGINT % 1000000
        AS STRING), 6, '0') AS abha_id FROM intake""",
)
def n3(spark, sf):
    return fixture(spark, sf, "intake").select(
        "notice_id", identity.surrogate_id(c("patient_name")).alias("abha_id")
    )


# --- W, L, U: ranking, limits, unions ---------------------------------------------------------


@query(
    "W2_keep_last",
    with_fixtures("batch2")
    + """SELECT * FROM batch2 QUALIFY row_number() OVER (PARTITION BY notice_id
        ORDER BY arrival_seq DESC) = 1""",
)
def w2(spark, sf):
    return tb.keep_last(fixture(spark, sf, "batch2"), "notice_id", "arrival_seq")


def _marked(seed: str, share: float) -> str:
    return f"""coalesce(notice_id IS NOT NULL AND count(notice_id) OVER (ORDER BY
        md5(notice_id || '|{seed}') NULLS LAST, notice_id RANGE UNBOUNDED PRECEDING)
        <= floor(count(notice_id) OVER () * {share}::DOUBLE), false)"""


# Every 53rd record has no key, and every 47th the key of another one.
MESSY_KEYS = """SELECT * REPLACE (CASE WHEN k % 53 = 0 THEN NULL WHEN k % 47 = 0 THEN
    'N-2026-CONS-v1.0-' || CAST(k % 470 AS STRING) ELSE notice_id END AS notice_id) FROM base"""


@query(
    "W4_scenario_marking",
    with_fixtures("base", keyed=MESSY_KEYS)
    + f"""SELECT notice_id, CASE WHEN NOT m1 THEN abha_id END AS abha_id,
        CASE WHEN m2 THEN 'REVOKED' ELSE consent_status END AS consent_status,
        CASE WHEN m3 THEN '1998-05-31' ELSE notice_date END AS notice_date
        FROM (SELECT *, {_marked('id', 0.15)} AS m1, {_marked('consent', 0.10)} AS m2,
            {_marked('date', 0.05)} AS m3 FROM keyed) t""",
)
def w4(spark, sf):
    base = fixture(spark, sf, "base")
    other = F.concat(F.lit("N-2026-CONS-v1.0-"), (c("k") % 470).cast("string"))
    key = F.when(c("k") % 53 == 0, None).when(c("k") % 47 == 0, other).otherwise(c("notice_id"))
    out = sampling.mark_scenarios(base.withColumn("notice_id", key), AS_OF)
    return out.select("notice_id", "abha_id", "consent_status", "notice_date")


@query(
    "L1_first_or_padded",
    INTAKE
    + """SELECT notice_id, patient_name, 0 AS origin FROM
        (SELECT * FROM intake ORDER BY notice_id LIMIT 1000) t""",
)
def l1(spark, sf):
    own = fixture(spark, sf, "intake").select("notice_id", "patient_name", F.lit(0).alias("origin"))
    filler = sampling.synthetic_v1(spark.range(1000), AS_OF).select(
        "notice_id", "patient_name", F.lit(1).alias("origin")
    )
    return sampling.first_or_padded(own, 1000, "notice_id", filler)


@query(
    "L2_truncation",
    """SELECT doc_id, left(text, 2000) AS payload, left(text, 200) AS summary, left(text, 100) AS snippet
        FROM documents""",
)
def l2(spark, sf):
    cuts = {"payload": v.REPORT_PAYLOAD_CHARS, "summary": v.SUMMARY_CHARS, "snippet": v.SNIPPET_CHARS}
    return table(spark, sf, "documents").select(
        "doc_id", *[F.left("text", F.lit(n)).alias(name) for name, n in cuts.items()]
    )


@query(
    "U1_concat_batches",
    with_fixtures("intake", "registry")
    + """SELECT patient_name, abha_id, consent_status, notice_id, bill_amount, CAST(NULL AS STRING)
        AS reg_seq FROM intake
        UNION ALL SELECT patient_name, abha_id, consent_status, NULL, NULL, CAST(reg_seq AS STRING)
        FROM registry""",
)
def u1(spark, sf):
    one = fixture(spark, sf, "intake").select(
        "patient_name", "abha_id", "consent_status", "notice_id", "bill_amount"
    )
    two = fixture(spark, sf, "registry").withColumn("reg_seq", c("reg_seq").cast("string"))
    return one.unionByName(two, allowMissingColumns=True)


# --- G: generation ----------------------------------------------------------------------------


def _u(what: str) -> str:
    return (
        f"(('0x' || substr(md5(CAST(o_orderkey AS STRING) || '|{what}|7'), 1, 7))::BIGINT "
        f"/ 268435456.0::DOUBLE)"
    )


def _int(what: str, low: int, high: int) -> str:
    return f"CAST({low} + floor({_u(what)} * {high - low + 1}) AS INT)"


def _pick(what: str, values: tuple[str, ...]) -> str:
    listed = ", ".join(q.lit(x) for x in values)
    return f"([{listed}])[{_int(what, 1, len(values))}]"


def _d(what: str) -> str:
    return f"CAST({_int(what, 1000, 9999)} AS STRING)"


GOOD = f"CAST({_int('p1', 10, 99)} AS STRING) || '-' || {_d('p2')} || '-' || {_d('p3')} || '-' || {_d('p4')}"
BAD = f"'ABHA-' || CAST({_int('bad', 100, 999)} AS STRING)"
VERSION = f"""'N-' || CASE WHEN {_u('year')} < 0.05 THEN '2025' ELSE '2026' END || '-CONS-v1.'
    || CAST({_int('minor', 0, 9)} AS STRING)"""
DAY = f"CAST(CAST(DATE '1998-07-01' - {_int('age', 0, 450)} AS DATE) AS STRING)"
NAME = f"'Patient_' || CAST(o_orderkey + 1 AS STRING) || '_' || {_d('suffix')}"


@query(
    "G1_synthetic_current",
    f"""SELECT {NAME} AS patient_name, CASE WHEN m >= 0.85 AND m < 0.9 THEN NULL
            WHEN m >= 0.8 AND m < 0.85 THEN {BAD} ELSE {GOOD} END AS abha_id,
        CASE WHEN m < 0.8 THEN '{{"diagnosis": "' || {_pick('diag', sampling.CLEAN_DIAGNOSES)}
                || '", "treatment": "Prescribed rest", "visit_type": "OPD"}}'
            WHEN m >= 0.9 AND m < 0.95 THEN 'XYZ-LOG: No clinical notes available, unknown condition.'
            ELSE 'Standard clinical examination.' END AS clinical_payload,
        CASE WHEN m >= 0.9 AND m < 0.95 THEN 3000 + {_int('bill', 0, 500000)} / 100.0::DOUBLE
            ELSE 500 + {_int('bill', 0, 150000)} / 100.0::DOUBLE END AS bill_amount,
        CASE WHEN m >= 0.95 THEN 'REVOKED' ELSE 'ACTIVE' END AS consent_status,
        {VERSION} || '-' || {_d('suffix')} || '-' || CAST(o_orderkey AS STRING) AS notice_id,
        {DAY} AS notice_date, {_pick('purpose', sampling.PURPOSES)} AS data_purpose
        FROM (SELECT *, {_u('mix')} AS m FROM orders) t""",
)
def g1(spark, sf):
    ids = table(spark, sf, "orders").select(c("o_orderkey").alias("id"))
    return sampling.synthetic_current(ids, AS_OF)


@query(
    "G2_synthetic_v1",
    f"""SELECT {NAME} AS patient_name, CASE WHEN m < 0.05 THEN NULL WHEN m < 0.1 THEN {BAD}
            ELSE {GOOD} END AS abha_id,
        '{{"diagnosis": "' || {_pick('diag', ('Condition', 'Issue', 'Case'))} || '_' ||
            CAST(o_orderkey + 1 AS STRING) || '", "treatment": "Treatment_' ||
            CAST(o_orderkey + 1 AS STRING) || '", "visit_type": "' || {_pick('visit', ('OPD', 'IPD', 'EMERGENCY'))}
            || '"}}' AS clinical_payload,
        {_pick('consent', ('ACTIVE', 'PENDING', 'GRANTED', 'REVOKED'))} AS consent_status,
        {VERSION} AS notice_id, {DAY} AS notice_date,
        {_pick('purpose', (*sampling.PURPOSES, 'Marketing'))} AS data_purpose
        FROM (SELECT *, {_u('mix')} AS m FROM orders) t""",
)
def g2(spark, sf):
    ids = table(spark, sf, "orders").select(c("o_orderkey").alias("id"))
    return sampling.synthetic_v1(ids, AS_OF)

"""Seeded generation and exact-share marking.

Everything is a function of a key and a seed, never of a random generator, so any partitioning and
any retry gives the same rows.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardgate.functions import vocab as v

# Share and seed of each scenario, drawn independently of the others.
SCENARIOS = {"null_id": (0.15, "id"), "revoked": (0.10, "consent"), "expired": (0.05, "date")}
EXPIRED_AGE_DAYS = 31
PREFIX_CHARS = (4, 8, None)  # hex digits: 65 536 prefixes at a time, then whole draws


def draw(key: Column, seed: str) -> Column:
    """Order of a key in a draw: its hash, then the key itself."""
    text = key.cast("string")
    return F.concat(F.md5(F.concat(text, F.lit(f"|{seed}"))), F.lit("|"), text)


def _cuts(df: DataFrame, key: str) -> dict[str, str | None]:
    """The first draw beyond the share of each scenario (None: all are inside).

    Rows with a key are counted per prefix of their hash, for all scenarios together; the running
    total over a bounded number of prefixes names the one the cut falls into, and only its keys are
    counted by a longer prefix.  Rows of one key are inside together, so a share is never exceeded.
    """
    draws = F.array(
        *[F.struct(F.lit(n).alias("s"), draw(F.col(key), seed).alias("d")) for n, (_, seed) in SCENARIOS.items()]
    )
    drawn = df.filter(F.col(key).isNotNull()).select(F.inline(draws))
    edge: dict[str, tuple[str, int]] = {}
    for chars in PREFIX_CHARS:
        inside = drawn
        if edge:
            prefixes = [(F.col("s") == n) & F.col("d").startswith(p) for n, (p, _) in edge.items()]
            inside = drawn.filter(reduce(lambda a, b: a | b, prefixes))
        elif chars != PREFIX_CHARS[0]:
            break
        prefix = F.col("d") if chars is None else F.left("d", F.lit(chars))
        counts = inside.groupBy("s", prefix.alias("b")).agg(F.count("*").alias("n"))
        by = Window.partitionBy("s")
        upto = F.sum("n").over(by.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        room = F.lit(None).cast("long")
        for n, (share, _) in SCENARIOS.items():
            rest = F.lit(edge[n][1]) if n in edge else F.floor(F.sum("n").over(by) * F.lit(share))
            room = F.when(F.col("s") == n, rest).otherwise(room)
        beyond = counts.withColumns({"upto": upto, "room": room}).filter(F.col("upto") > F.col("room"))
        first = beyond.groupBy("s").agg(
            F.min(F.struct("b", (F.col("room") - F.col("upto") + F.col("n")).alias("rest"))).alias("e")
        )
        edge = {r.s: (r.e.b, r.e.rest) for r in first.collect()}
    return {n: edge[n][0] if n in edge else None for n in SCENARIOS}


def mark_scenarios(df: DataFrame, as_of: datetime, key: str = "notice_id") -> DataFrame:
    """At most the stated share of rows without an id, revoked, and with an old notice date.

    With unique keys the share is exact.  Rows without a key are neither counted nor marked.
    """
    cuts = _cuts(df, key)
    keyed = F.col(key).isNotNull()
    marks = {
        name: keyed if cuts[name] is None else keyed & (draw(F.col(key), seed) < F.lit(cuts[name]))
        for name, (_, seed) in SCENARIOS.items()
    }
    old = (as_of - timedelta(days=EXPIRED_AGE_DAYS)).date().isoformat()
    return df.withColumns(
        {
            "abha_id": F.when(~marks["null_id"], F.col("abha_id")),
            "consent_status": F.when(marks["revoked"], "REVOKED").otherwise(F.col("consent_status")),
            "notice_date": F.when(marks["expired"], old).otherwise(F.col("notice_date")),
        }
    )


def first_or_padded(df: DataFrame, n: int, order: str, filler: DataFrame) -> DataFrame:
    """The first ``n`` rows in key order, filled up from ``filler`` when there are fewer."""
    own = df.withColumn("_src", F.lit(0))
    more = filler.withColumn("_src", F.lit(1))
    both = own.unionByName(more, allowMissingColumns=True)
    return both.orderBy("_src", order).limit(n).drop("_src")


# --- generation -------------------------------------------------------------------------------
# One record per row of ``ids`` (column ``id``), for instance ``spark.range(n)``.


def _uniform(seed: int, what: str) -> Column:
    """Even value in [0, 1) per row id and purpose."""
    text = F.concat(F.col("id").cast("string"), F.lit(f"|{what}|{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("bigint") / F.lit(float(1 << 28))


def _between(seed: int, what: str, low: int, high: int) -> Column:
    return (F.lit(low) + F.floor(_uniform(seed, what) * (high - low + 1))).cast("int")


def _choice(seed: int, what: str, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in values]), _between(seed, what, 1, len(values)))


def _digits(seed: int, what: str) -> Column:
    return F.lpad(_between(seed, what, 1000, 9999).cast("string"), 4, "0")


def _frame(ids: DataFrame, seed: int, as_of: datetime) -> DataFrame:
    good_id = F.concat_ws(
        "-",
        _between(seed, "p1", 10, 99).cast("string"),
        *[_digits(seed, p) for p in ("p2", "p3", "p4")],
    )
    suffix = _digits(seed, "suffix")
    year = F.when(_uniform(seed, "year") < 0.05, "2025").otherwise("2026")
    age = _between(seed, "age", 0, 450)
    return ids.select(
        "id",
        F.concat(F.lit("Patient_"), (F.col("id") + 1).cast("string"), F.lit("_"), suffix).alias(
            "patient_name"
        ),
        good_id.alias("good_id"),
        F.concat(F.lit("ABHA-"), _between(seed, "bad", 100, 999).cast("string")).alias("bad_id"),
        F.concat(
            F.lit("N-"), year, F.lit("-CONS-v1."), _between(seed, "minor", 0, 9).cast("string")
        ).alias("version"),
        suffix.alias("suffix"),
        F.date_format(F.date_sub(F.lit(as_of.date()), age), "yyyy-MM-dd").alias("notice_date"),
    )


# What generated records say.
CLEAN_DIAGNOSES = ("Hypertension", "Diabetes", "Asthma", "Fever")
PURPOSES = ("Consultation", "Treatment", "Audit", "Emergency Care")


def synthetic_current(ids: DataFrame, as_of: datetime, seed: int = 7) -> DataFrame:
    """80 % clean records; the rest split evenly into the four kinds of trouble."""
    u = _uniform(seed, "mix")
    clean = u < 0.80
    bad_id, no_id = (u >= 0.80) & (u < 0.85), (u >= 0.85) & (u < 0.90)
    leak, revoked = (u >= 0.90) & (u < 0.95), u >= 0.95
    low = F.lit(500) + _between(seed, "bill", 0, 150_000) / F.lit(100.0)
    high = F.lit(3000) + _between(seed, "bill", 0, 500_000) / F.lit(100.0)
    payload = F.format_string(
        '{"diagnosis": "%s", "treatment": "Prescribed rest", "visit_type": "OPD"}',
        _choice(seed, "diag", CLEAN_DIAGNOSES),
    )
    return _frame(ids, seed, as_of).select(
        "patient_name",
        F.when(no_id, None).when(bad_id, F.col("bad_id")).otherwise(F.col("good_id")).alias("abha_id"),
        F.when(clean, payload)
        .when(leak, "XYZ-LOG: No clinical notes available, unknown condition.")
        .otherwise("Standard clinical examination.")
        .alias("clinical_payload"),
        F.when(leak, high).otherwise(low).alias("bill_amount"),
        F.when(revoked, "REVOKED").otherwise("ACTIVE").alias("consent_status"),
        F.concat_ws("-", "version", "suffix", F.col("id").cast("string")).alias("notice_id"),
        "notice_date",
        _choice(seed, "purpose", PURPOSES).alias("data_purpose"),
    )


def synthetic_v1(ids: DataFrame, as_of: datetime, seed: int = 7) -> DataFrame:
    """5 % without id, 5 % malformed, 5 % legacy notices, four consent states, five purposes."""
    u = _uniform(seed, "mix")
    n = (F.col("id") + 1).cast("string")
    payload = F.format_string(
        '{"diagnosis": "%s_%s", "treatment": "Treatment_%s", "visit_type": "%s"}',
        _choice(seed, "diag", ("Condition", "Issue", "Case")),
        n,
        n,
        _choice(seed, "visit", v.VISIT_TYPES[:3]),
    )
    return _frame(ids, seed, as_of).select(
        "patient_name",
        F.when(u < 0.05, None).when(u < 0.10, F.col("bad_id")).otherwise(F.col("good_id")).alias("abha_id"),
        payload.alias("clinical_payload"),
        _choice(seed, "consent", ("ACTIVE", "PENDING", "GRANTED", "REVOKED")).alias("consent_status"),
        F.col("version").alias("notice_id"),
        "notice_date",
        _choice(seed, "purpose", (*PURPOSES, "Marketing")).alias("data_purpose"),
    )

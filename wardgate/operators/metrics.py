"""Scorecards and top-k reports.  Every one is a map-side combined aggregate over few groups."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardgate.functions import payload as pl
from wardgate.functions import rules as r
from wardgate.functions import vocab as v
from wardgate.operators.dispositions import apply_erasure_policy
from wardgate.operators.tables import KeyedTable, Tally

MONEY = "decimal(18,2)"


def _share(part: Column, total: Column) -> Column:
    return F.coalesce(F.lit(100.0) * part / F.nullif(total, F.lit(0)), F.lit(0.0))


def scorecard(gated: DataFrame) -> DataFrame:
    """Total and count per status, in one pass."""
    status = F.col("ingest_status")
    return gated.agg(
        F.count("*").alias("total"),
        F.count_if(status == "PROCESSED").alias("processed"),
        F.count_if(status == "PURGED").alias("purged"),
        F.count_if(status == "QUARANTINED").alias("quarantined"),
    )


def scorecard_rows(gated: DataFrame) -> DataFrame:
    """The scorecard as (status, count) rows."""
    return scorecard(gated).select(
        F.stack(
            F.lit(3),
            F.lit("Success"), F.col("processed"),
            F.lit("Purged"), F.col("purged"),
            F.lit("Quarantined"), F.col("quarantined"),
        ).alias("status", "count")
    )


def shares(gated: DataFrame) -> DataFrame:
    """Percent of records per status; zero for an empty batch."""
    return scorecard(gated).select(
        *[
            _share(F.col(c), F.col("total")).alias(f"{c}_pct")
            for c in ("processed", "purged", "quarantined")
        ]
    )


def reasons(gated: DataFrame) -> DataFrame:
    """Records per reason of the purged and quarantined ones."""
    return (
        gated.filter(F.col("ingest_status").isin("PURGED", "QUARANTINED"))
        .groupBy("ingest_status", "status_reason")
        .agg(F.count("*").alias("n"))
    )


def disposition_summary(gated: DataFrame) -> DataFrame:
    """Records and billed amount per status and reason."""
    return gated.groupBy("ingest_status", "status_reason").agg(
        F.count("*").alias("n"), F.sum(F.col("bill_amount").cast(MONEY)).alias("bill_total")
    )


#: The disposition summary as a tally that a stored table keeps.
DISPOSITIONS = Tally(("ingest_status", "status_reason"), {"bill_total": "bill_amount"}, MONEY)


def kept_summary(table: KeyedTable) -> DataFrame:
    """:func:`disposition_summary` of a stored table from its kept tally: no row of the table is read."""
    return DISPOSITIONS.shown(table.tallied())


def kept_scorecard(table: KeyedTable) -> DataFrame:
    """:func:`scorecard` of a stored table from its kept tally."""
    of = lambda s: F.coalesce(F.sum(F.when(F.col("ingest_status") == s, F.col("n"))), F.lit(0))
    return table.tallied().agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        *[of(s.upper()).alias(s) for s in ("processed", "purged", "quarantined")],
    )


def revenue_on_hold(gated: DataFrame) -> DataFrame:
    """Billed amount waiting for clinical evidence."""
    return gated.filter(F.col("status_reason") == "PENDING_CLINICAL_AUDIT").agg(
        F.count("*").alias("held"),
        F.coalesce(F.sum(F.col("bill_amount").cast(MONEY)), F.lit(0).cast("decimal(28,2)")).alias(
            "hold_amount"
        ),
    )


def flow(gated: DataFrame) -> DataFrame:
    """Intake, cleared and not cleared."""
    status = F.col("ingest_status")
    return gated.agg(
        F.count("*").alias("intake"),
        F.count_if(status == "PROCESSED").alias("cleared"),
        F.count_if(status != "PROCESSED").alias("not_cleared"),
    )


def outcome_summary(outcomes: DataFrame) -> DataFrame:
    """Linked, purged and quarantined records by the outcome's wording."""
    outcome = F.col("outcome")
    label = (
        F.when(outcome.contains("SUCCESS"), "Linked")
        .when(outcome.contains("PURGED"), "Purged")
        .otherwise("Quarantined")
    )
    return outcomes.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def category_items(df: DataFrame) -> DataFrame:
    """``category``, ``item``: every visit type, diagnosis, medication and lab test named by the payloads."""
    obj = pl.payload_object(F.col("clinical_payload"))

    def item(category: str, key: str) -> Column:
        if key == "visit_type":
            return pl.visit_type_with_fallback(
                F.col("_o"), F.coalesce("clinical_payload", F.lit("None"))
            )
        named = F.nullif(F.try_element_at(F.col("_o"), F.lit(key)), F.lit(""))
        return F.nullif(named, F.lit("None")) if key in ("medication", "lab_test") else named

    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("category"), item(c, k).alias("item"))
            for c, k in v.CATEGORY_KEYS.items()
        ]
    )
    return (
        df.select("clinical_payload", obj.alias("_o"))
        .select(F.inline(pairs))
        .filter(F.col("item").isNotNull())
    )


def category_counts(df: DataFrame) -> DataFrame:
    """Frequency of every item of :func:`category_items`."""
    return category_items(df).groupBy("category", "item").agg(F.count("*").alias("n"))


def top_items(counts: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most frequent items of each category; equal counts in item order."""
    order = Window.partitionBy("category").orderBy(F.desc("n"), F.asc("item"))
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def bounded_top_items(items: DataFrame, k: int = 5, tracked: int = 10_000, named: int = 1_000) -> DataFrame:
    """:func:`top_items` of (``category``, ``item``) rows of free text, exact, without counting every item.

    A mergeable sketch of ``tracked`` counters a category names the ``named`` most frequent items, and only these are counted, in a
    second pass.  An item that is not named occurs at most as often as the last named one may, and as the sketch's error allows
    (3.5 in ``tracked`` of all rows); where the k-th count is above that, or the named items are all there are, nothing is missed.
    Categories for which that cannot be said are counted in full.
    """
    sketch = items.groupBy("category").agg(
        F.count("*").alias("_all"), F.expr(f"approx_top_k(item, {named}, {tracked})").alias("_top")
    )
    last = F.when(F.size("_top") == named, F.array_min(F.transform("_top", lambda x: x["count"]))).otherwise(0)
    sketch = sketch.withColumn("_bound", F.greatest(last, F.ceil(F.lit(3.5) * F.col("_all") / tracked)))
    asked = sketch.select("category", F.explode(F.col("_top")["item"]).alias("item"))
    counts = items.join(asked, ["category", "item"]).groupBy("category", "item").agg(F.count("*").alias("n"))
    best = top_items(counts, k)
    seen = counts.groupBy("category").agg(F.sum("n").alias("_seen"))
    kth = best.filter(F.col("rank") == k).select("category", F.col("n").alias("_kth"))
    told = sketch.join(seen, "category", "left").join(kth, "category", "left")
    sure = F.coalesce(F.col("_kth") > F.col("_bound"), F.lit(False)) | F.coalesce(F.col("_seen") == F.col("_all"), F.lit(False))
    certain = told.filter(sure).select("category")
    unsure = told.filter(~sure).select("category")
    full = items.join(unsure, "category", "left_semi").groupBy("category", "item").agg(F.count("*").alias("n"))
    return best.join(certain, "category", "left_semi").unionByName(top_items(full, k))


def compliance_stats(df: DataFrame, as_of: datetime, days: int = v.REPORTING_EXPIRY_DAYS) -> DataFrame:
    """Records without an id, revoked, and with an old notice, each with its percentage."""
    counts = df.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("abha_id").isNull()).alias("null_ids"),
        F.count_if(F.col("consent_status") == "REVOKED").alias("revoked"),
        F.count_if(r.is_expired(F.col("notice_date"), as_of, days)).alias("expired"),
    )
    pct = {f"{c}_pct": _share(F.col(c), F.col("total")) for c in ("null_ids", "revoked", "expired")}
    return counts.withColumns(pct)


def format_summary(rows: DataFrame, format_: str = "format", file: str = "file") -> DataFrame:
    """Files and rows per source format.  Rows are first combined per file, so a format or a file
    with very many rows never meets in one task."""
    return (
        rows.groupBy(format_, file)
        .agg(F.count("*").alias("_n"))
        .groupBy(format_)
        .agg(F.count("*").alias("files"), F.sum("_n").alias("rows"))
    )


def linked_outcomes(df: DataFrame, as_of: datetime) -> DataFrame:
    """Adapter batch after coding and the erasure policy: the input of its exports and reports."""
    obj = pl.payload_object(F.col("clinical_payload"))
    coded = (
        df.withColumn("_o", obj)
        .withColumns({"visit_type": pl.visit_type(F.col("_o")), "diagnosis": pl.diagnosis(F.col("_o"))})
        .withColumn("snomed_code", pl.snomed_code(F.col("diagnosis"), ""))
        .drop("_o")
    )
    return apply_erasure_policy(coded, as_of)

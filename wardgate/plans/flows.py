"""The operators put together: intake, desk corrections, adapter batch."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardgate.functions import privacy as p
from wardgate.operators import aliases, dispositions, identity, metrics, naming
from wardgate.operators import tables as tb
from wardgate.sources import intake
from wardgate.workspace import delete_path, is_committed


def gate_intake(raw: DataFrame) -> DataFrame:
    """Current intake: canonical names, then the gate."""
    return dispositions.apply_gate(naming.canonical_rename(raw))


def intake_v1(
    raw: DataFrame,
    as_of: datetime,
    overrides: Mapping[str, str] | None = None,
    autofill: bool = False,
) -> DataFrame:
    """First intake version: synonyms, recovery of missing fields, then its own policy."""
    named = naming.synonym_rename(raw, overrides, autofill)
    return dispositions.apply_intake_v1(naming.recover_fields(named), as_of)


def adapter_batch(
    raw: DataFrame,
    as_of: datetime,
    registry: DataFrame | None = None,
    links: DataFrame | None = None,
) -> DataFrame:
    """Adapter batch: aliases, identity, clinical coding, erasure policy, wiping."""
    records = identity.resolve_identity(aliases.standardize(raw), registry, links)
    return dispositions.wipe_purged(metrics.linked_outcomes(records, as_of))


# How each desk's corrections are logged.
DESK_EVENTS = {
    "IDENTITY": ("ABHA_OVERRIDE", "Identity Desk"),
    "CLINICAL": ("CLINICAL_OVERRIDE", "Clinical Desk"),
}
DESK_COLUMNS = {"IDENTITY": ["abha_id"], "CLINICAL": ["clinical_payload", "bill_amount"]}


def correct(
    patients: tb.KeyedTable,
    edits: DataFrame,
    desk: str,
    as_of: datetime,
    work_path: str,
    batch: str,
    arrival: str,
    given: str | None = None,
) -> None:
    """Take in a named batch of a desk's edits: log the changed records, gate them again and store them.

    Of several edits of a record the last by ``arrival`` counts; ``given`` as in ``apply_corrections``.  The
    changed records are written once, below ``work_path``; trail and table are made from them, so a batch given
    again, or one that broke off, leaves the same trail and the same table.  Every rule looks at one
    record, so only corrected records are gated again.
    """
    columns = DESK_COLUMNS[desk]
    event, label = DESK_EVENTS[desk]
    spark = edits.sparkSession
    folder = f"{work_path}/corrected/{batch}"
    if not is_committed(spark, folder):
        last = tb.keep_last(edits.filter(F.col(patients.key).isNotNull()), patients.key, arrival)
        waiting = patients.rows_near(last).filter(F.col("status_reason") == dispositions.DESKS[desk][0])
        changed = tb.apply_corrections(waiting, last, columns, patients.key, (), given, changed_only=True)
        rows = tb.to_stored(dispositions.apply_gate(changed), as_of)
        rows.write.mode("overwrite").parquet(folder)
    done = spark.read.schema(tb.PATIENTS).parquet(folder)
    events = tb.audit_events(
        done,
        as_of,
        F.lit(event),
        p.id_token(F.col(patients.key)),
        F.lit(label),
        F.lit(f"Corrected {', '.join(columns)}"),
    )
    tb.write_audit(events, f"{work_path}/audit", batch)
    patients.upsert(done)


def purge(patients: tb.KeyedTable, reason: str, as_of: datetime, audit_path: str, batch: str) -> None:
    """Delete the records held for ``reason``, then record the event with their number.

    The number is written before the rows go, under the batch's name, so that a purge that broke off is finished with
    the number it began with.
    """
    pending = f"{audit_path}-pending/{batch}"
    spark = patients.spark
    if not is_committed(spark, pending):
        doomed = patients.current().filter(F.col("status_reason") == reason)
        doomed.agg(F.count("*").alias("n")).write.mode("overwrite").parquet(pending)
    patients.delete_where(F.col("status_reason") == reason)
    events = tb.audit_events(
        spark.read.parquet(pending),
        as_of,
        F.lit("RULE_8_PURGE"),
        F.format_string("%d Records", F.col("n")),
        F.lit("DPDP Rule 8"),
        F.lit(f"Purge of {reason}"),
    )
    tb.write_audit(events, audit_path, batch)


def reset(patients: tb.KeyedTable, audit_path: str) -> None:
    """Empty the table and its trail."""
    patients.clear()
    delete_path(patients.spark, audit_path)


def adapter_landing(
    spark: SparkSession, path: str, as_of: datetime, registry: DataFrame, links: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(adapter records, rejects) of a folder of mixed files: aliases, identity, coding, erasure, wiping."""
    records, rejects = intake.take_in(spark, path, intake.by_alias)
    return adapter_batch(records.drop("path", "format"), as_of, registry, links), rejects

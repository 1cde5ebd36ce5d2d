"""Incremental intake: new files are gated and upserted as they land."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardgate.operators import naming
from wardgate.operators.dispositions import apply_gate
from wardgate.operators.tables import KeyedTable, audit_events, to_stored
from wardgate.sources import intake
from wardgate.workspace import delete_path


#: What orders the arrivals of a key: when its file landed, then the file.
LANDED = T.StructType([T.StructField("landed", T.TimestampType()), T.StructField("path", T.StringType())])


def intake_stream(
    spark: SparkSession,
    landing: str,
    table: KeyedTable,
    audit_path: str,
    checkpoint: str,
    as_of: datetime,
    rejects_path: str | None = None,
    name_of: intake.Naming = intake.by_canonical,
    files_per_batch: int | None = None,
    name: str = "stream",
    oldest: str = "365d",
):
    """Start the job over JSON-lines files and return its query; it ends when all are taken in.

    The table is the state, so no watermark is needed; one made with the versions ``LANDED`` keeps what landed last, also when
    an older file is taken in late.  Files older than ``oldest``, counted from the newest one seen, are not taken in.  Members are mapped by ``name_of``; lines that hold no
    record and records without a key go to ``rejects_path`` (default: beside the trail).  A micro-batch
    delivered again after a lost executor or driver replaces its own rows, rejects and audit row.
    """
    rejects_path = rejects_path or f"{audit_path}-rejects"
    staged = f"{table.root}-arrivals"
    reader = spark.readStream.option("maxFileAge", oldest)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    arrivals = reader.text(landing).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_modification_time").alias("landed"),
        F.col("value").alias("body"),
    )

    def take_in(batch: DataFrame, batch_id: int) -> None:
        # Parsed once and kept until the batch is stored: records, rejects and their count are read from there.
        parsed = intake.json_verdicts(batch, name_of, intake.known_names())
        parsed.write.mode("overwrite").parquet(staged)
        good, bad = intake.by_verdict(spark.read.schema(parsed.schema).parquet(staged))
        keyless = good.filter(F.col(table.key).isNull())
        texts = F.to_json(F.struct(*[x for x in good.columns if x not in ("path", "landed")]))
        bad = bad.unionByName(keyless.select("path", texts.alias("text"), F.lit("no key").alias("reason")))
        bad.write.mode("overwrite").parquet(f"{rejects_path}/stream={name}/batch={batch_id}")
        gated = apply_gate(naming.canonical_rename(good.filter(F.col(table.key).isNotNull())))
        table.upsert(to_stored(gated, as_of, "landed", "path"), "landed", "path")
        events = audit_events(
            good.agg(F.count("*").alias("n")),
            as_of,
            F.lit("INTAKE"),
            F.format_string("%d Records", F.col("n")),
            F.lit("Intake gate"),
            F.lit(f"Micro-batch {batch_id} gated and stored"),
        )
        events.write.mode("overwrite").parquet(f"{audit_path}/stream={name}/batch={batch_id}")
        delete_path(spark, staged)

    return (
        arrivals.writeStream.foreachBatch(take_in)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

"""FHIR exports: one bundle entry per row, bundles only in bounded chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardgate.functions import payload as pl
from wardgate.functions import vocab as v
from wardgate.workspace import landed


def _json(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def collection_entries(gated: DataFrame) -> DataFrame:
    """``full_url``, ``resource`` of every processed record, as entries of a collection bundle."""
    extension = F.array(
        F.struct(
            F.lit(v.FHIR_CONSENT_EXTENSION).alias("url"),
            F.col("consent_status").alias("valueString"),
        ),
        F.struct(
            F.lit(v.FHIR_NOTICE_EXTENSION).alias("url"), F.col("notice_id").alias("valueString")
        ),
    )
    patient = F.struct(
        F.lit("Patient").alias("resourceType"),
        F.array(
            F.struct(F.lit(v.FHIR_ID_SYSTEM).alias("system"), F.col("abha_id").alias("value"))
        ).alias("identifier"),
        F.array(F.struct(F.col("patient_name").alias("text"))).alias("name"),
        extension.alias("extension"),
    )
    return gated.filter(F.col("ingest_status") == "PROCESSED").select(
        F.concat(F.lit("urn:uuid:"), F.coalesce("notice_id", F.lit("None"))).alias("full_url"),
        _json(patient).alias("resource"),
    )


def stable_uuid(key: Column) -> Column:
    """UUID-shaped id derived from a key, so that an export can be repeated."""
    h = F.sha2(key, 256)
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts])


def transaction_entries(outcomes: DataFrame) -> DataFrame:
    """``notice_id``, ``seq``, ``resource``, ``url``: a Patient and a Condition per linked record."""
    staged = outcomes.filter(F.col("outcome") == "SUCCESS_LINKED").withColumns(
        {
            "_pid": stable_uuid(F.col("notice_id")),
            "_text": pl.condition_text(F.col("clinical_payload")),
        }
    )
    patient = F.struct(
        F.lit("Patient").alias("resourceType"),
        F.col("_pid").alias("id"),
        F.array(
            F.struct(
                F.lit(v.FHIR_TRANSACTION_ID_SYSTEM).alias("system"),
                F.col("abha_id").alias("value"),
            )
        ).alias("identifier"),
        F.array(F.struct(F.col("patient_name").alias("text"))).alias("name"),
    )
    condition = F.struct(
        F.lit("Condition").alias("resourceType"),
        F.struct(F.concat(F.lit("urn:uuid:"), "_pid").alias("reference")).alias("subject"),
        F.struct(
            F.array(
                F.struct(
                    F.lit(v.SNOMED_SYSTEM).alias("system"),
                    pl.snomed_code(F.col("_text"), v.SNOMED_FALLBACK).alias("code"),
                    F.col("_text").alias("display"),
                )
            ).alias("coding"),
            F.col("_text").alias("text"),
        ).alias("code"),
    )
    entries = F.array(
        F.struct(F.lit(1).alias("seq"), _json(patient).alias("resource"), F.lit("Patient").alias("url")),
        F.struct(
            F.lit(2).alias("seq"), _json(condition).alias("resource"), F.lit("Condition").alias("url")
        ),
    )
    return staged.select("notice_id", F.inline(entries))


CELLS = 1024  # of the hash that deals the entries of a chunk to tasks
MOST = 1000  # entries of a bundle


def _parts(entries: DataFrame, most: int, *also: Column) -> DataFrame:
    """``entries`` with ``part``: their number within ``chunk``, cut every ``most``; landed.  ``also`` counts for the hash.

    Entries are numbered in their hash cell, the cells of a chunk are added up, and an entry adds its number in its
    cell to what stands before the cell; no task sees a whole chunk.
    """
    cell = F.pmod(F.xxhash64(*entries.columns, *also), F.lit(CELLS))
    within = F.row_number().over(Window.partitionBy("chunk", "_cell").orderBy(*entries.columns)) - 1
    dealt = landed(entries.withColumn("_cell", cell).withColumn("_in", within), "entries")
    counts = dealt.groupBy("chunk", "_cell").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("chunk").orderBy("_cell")) - F.col("_n")
    starts = landed(counts.select(F.col("chunk").alias("_chunk"), F.col("_cell").alias("_c"), before.alias("_start")), "cells")
    joined = dealt.join(starts, F.col("chunk").eqNullSafe(F.col("_chunk")) & (F.col("_cell") == F.col("_c")))
    return joined.select(*entries.columns, F.floor((F.col("_start") + F.col("_in")) / most).alias("part"))


def bundles(entries: DataFrame, chunk: Column, order: str, kind: str, most: int = MOST) -> DataFrame:
    """``bundle_id`` (the chunk), ``part``, ``bundle``: bundles of at most ``most`` entries, whatever the chunk holds.

    Entries with a ``url`` carry a request, as a transaction needs; entries of one ``notice_id`` with a ``seq`` stay together
    (``most`` counts such groups then).
    """
    source = "url" if "url" in entries.columns else "full_url"

    def body(url: Column, resource: Column) -> Column:
        if source == "url":
            return F.concat(F.lit('{"resource":'), resource, F.lit(',"request":{"method":"POST","url":"'), url, F.lit('"}}'))
        return F.concat(F.lit('{"fullUrl":"'), url, F.lit('","resource":'), resource, F.lit("}"))

    shown = entries.select(chunk.alias("chunk"), F.col(order).alias("o"), F.col("resource"), body(F.col(source), F.col("resource")).alias("b"), *(["notice_id"] if _grouped(entries) else []))
    text = lambda x: x["b"]
    if _grouped(entries):
        key = [F.col("chunk"), F.col("notice_id")]
        groups = shown.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("o", "resource", "b"))).alias("e"))
        placed = _parts(groups, most)
        listed = F.flatten(F.array_sort(F.collect_list(F.struct("notice_id", "e")))["e"])
    elif order == source:  # the text follows from what it is ordered by, and is made last
        placed = _parts(shown.drop("b"), most, body(F.col("o"), F.col("resource")))
        listed = F.array_sort(F.collect_list(F.struct("o", "resource")))
        text = lambda x: body(x["o"], x["resource"])
    else:
        placed = _parts(shown, most)
        listed = F.array_sort(F.collect_list(F.struct("o", "resource", "b")))
    return placed.groupBy(F.col("chunk").alias("bundle_id"), "part").agg(
        F.concat(
            F.lit(f'{{"resourceType":"Bundle","type":"{kind}","entry":['),
            F.concat_ws(",", F.transform(listed, text)),
            F.lit("]}"),
        ).alias("bundle")
    )


def _grouped(entries: DataFrame) -> bool:
    return {"notice_id", "seq"} <= set(entries.columns)

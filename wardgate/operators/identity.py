"""Identity recovery by join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardgate.operators.tables import keep_first


def id_is_lacking(id_: Column) -> Column:
    return F.coalesce(F.trim(id_).isin("", "nan"), F.lit(True))


def surrogate_id(name: Column) -> Column:
    """``ABHA`` and six digits derived from the name; equal names get equal ids."""
    number = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("bigint")
    return F.format_string("ABHA%06d", F.pmod(number, F.lit(1000000)))


def resolve_identity(
    records: DataFrame,
    registry: DataFrame | None = None,
    links: DataFrame | None = None,
    registry_order: str = "reg_seq",
) -> DataFrame:
    """Fill missing ids: from the registry by name, else from the link table, else derived.

    With a link table at hand no id is derived, whether the link was found or not.  Only records
    that lack an id take part in the joins; the others go past them.  The lookup sides hold one
    row per name, so a name shared by many records multiplies nothing, and adaptive execution
    splits the partition of such a name.
    """
    lacking = id_is_lacking(F.col("abha_id"))
    complete = records.filter(~lacking).withColumn("discovery_status", F.lit(None).cast("string"))
    todo = records.filter(lacking)

    reg_id, reg_consent, reg_hit = F.lit(None).cast("string"), F.col("consent_status"), F.lit(False)
    if registry is not None:
        first = keep_first(registry, "patient_name", registry_order).select(
            "patient_name",
            F.col("abha_id").alias("_reg_id"),
            F.col("consent_status").alias("_reg_consent"),
            F.lit(True).alias("_reg_hit"),
        )
        todo = todo.join(first, "patient_name", "left")
        reg_hit = F.coalesce("_reg_hit", F.lit(False))
        reg_id = F.col("_reg_id")
        reg_consent = F.when(reg_hit, F.col("_reg_consent")).otherwise(F.col("consent_status"))

    if links is not None:
        one = keep_first(links, "patient_name", "abha_id").select(
            "patient_name", F.col("abha_id").alias("_link_id")
        )
        todo = todo.join(one, "patient_name", "left")
        other_id = F.coalesce("_link_id", "abha_id")
        other_tag = F.when(F.col("_link_id").isNotNull(), "LINKED_BY_GATEWAY")
    else:
        named = F.coalesce(F.col("patient_name") != "", F.lit(False))
        other_id = F.when(named, surrogate_id(F.col("patient_name"))).otherwise(F.col("abha_id"))
        other_tag = F.when(named, "LINKED_BY_M1")

    found = todo.select(
        *[
            {
                "abha_id": F.when(reg_hit, reg_id).otherwise(other_id).alias("abha_id"),
                "consent_status": reg_consent.alias("consent_status"),
            }.get(c, F.col(c))
            for c in records.columns
        ],
        F.when(reg_hit, "RECOVERED_FROM_DB").otherwise(other_tag).alias("discovery_status"),
    )
    return complete.unionByName(found)

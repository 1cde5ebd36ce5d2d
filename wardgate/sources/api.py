"""Landed API responses to records: unwrap the envelope, then rename by alias."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardgate.functions import payload as pl
from wardgate.functions import vocab as v
from wardgate.operators.aliases import field_of_key_sql, header_key_sql

ITEM = "map<string,string>"


def unwrap(
    docs: DataFrame, body: str = "body", keys: Iterable[str] = v.API_ENVELOPES
) -> DataFrame:
    """One row per item, as a map ``item``.  A response without an envelope is its own item.

    Unreadable responses yield no row here; :func:`unreadable` lists them.
    """
    text = F.trim(F.col(body))
    outer = F.when(text.startswith("{"), pl.json_object(text))
    inner = F.coalesce(*[F.try_element_at(F.col("_outer"), F.lit(k)) for k in keys], F.col("_text"))
    rest = [c for c in docs.columns if c != body]
    return (
        docs.withColumns({"_outer": outer, "_text": text})
        .withColumn("_inner", F.when(F.col("_outer").isNotNull() | text.startswith("["), inner))
        .withColumn(
            "_items",
            F.when(
                F.col("_inner").startswith("["), F.from_json(F.col("_inner"), f"array<{ITEM}>")
            ).otherwise(F.array(pl.json_object(F.col("_inner")))),
        )
        .select(*rest, F.explode_outer("_items").alias("item"))
        .filter(F.col("item").isNotNull())
    )


def unreadable(docs: DataFrame, body: str = "body") -> DataFrame:
    """Responses that are not complete JSON."""
    return docs.filter(F.try_parse_json(F.col(body)).isNull())


def records(docs: DataFrame, body: str = "body", keys: Iterable[str] = v.API_ENVELOPES) -> DataFrame:
    """Adapter record per item; of several members claiming one field the last one counts."""
    # The key is brought into its one spelling once, in a step of its own.
    named = F.expr(
        f"transform(transform(map_entries(item), e -> named_struct('key', {header_key_sql('e.key')}, 'value', e.value)), "
        f"e -> named_struct('field', {field_of_key_sql('e.key')}, 'value', e.value))"
    )
    rest = [c for c in docs.columns if c != body]

    def field(name: str):
        mine = F.filter("_named", lambda e: e["field"] == name)
        return F.try_element_at(mine, F.lit(-1))["value"].alias(name)

    return unwrap(docs, body, keys).select(*rest, named.alias("_named")).select(
        *rest, *[field(f) for f in v.ADAPTER_FIELDS if f != "data_purpose"]
    )

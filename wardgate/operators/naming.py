"""Bring batches of any header onto the canonical record: one ``select`` per operator."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardgate.functions import text as t
from wardgate.functions import vocab as v

AMOUNT = "bill_amount"


def _renames(columns: Iterable[str], canonical_of: Mapping[str, str]) -> dict[str, str]:
    found = {c: canonical_of[c.lower()] for c in columns if c.lower() in canonical_of}
    doubled = {x for x in found.values() if list(found.values()).count(x) > 1}
    if doubled:
        raise ValueError(f"more than one source column for {sorted(doubled)}")
    return found


def _with_missing(df: DataFrame, fills: Mapping[str, Column]) -> DataFrame:
    present = {c.lower() for c in df.columns}
    return df.withColumns({f: c for f, c in fills.items() if f.lower() not in present})


def canonical_rename(df: DataFrame) -> DataFrame:
    """Canonical names in any letter case; absent fields become null; the amount becomes a number."""
    out = df.withColumnsRenamed(_renames(df.columns, {f: f for f in v.CANONICAL}))
    out = _with_missing(out, {f: F.lit(None).cast("string") for f in v.CANONICAL})
    return out.withColumn(AMOUNT, t.amount(F.col(AMOUNT)))


def synonym_map(overrides: Mapping[str, str] | None = None) -> dict[str, str]:
    """Header synonyms, lower case, with the caller's own mapping merged last."""
    base = {s: field for field, names in v.INTAKE_V1_SYNONYMS.items() for s in names}
    return base | {k.lower(): x.lower() for k, x in (overrides or {}).items()}


def autofill_values() -> dict[str, Column]:
    return {
        f: F.lit(v.AUTOFILL.get(f, f"AUTO_{dict(v.CANONICAL)[f]}")) for f in v.INTAKE_V1_FIELDS
    }


def synonym_rename(
    df: DataFrame, overrides: Mapping[str, str] | None = None, autofill: bool = False
) -> DataFrame:
    """Headers by synonym; absent fields become null, or the documented default with ``autofill``."""
    out = df.withColumnsRenamed(_renames(df.columns, synonym_map(overrides)))
    nulls = {f: F.lit(None).cast("string") for f in v.INTAKE_V1_FIELDS}
    return _with_missing(out, autofill_values() if autofill else nulls)


def recover_fields(df: DataFrame) -> DataFrame:
    """Look for a missing id or name in the record's other values, then keep the v1 text fields."""
    filled = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    everything = F.concat_ws(" ", *filled)
    recovered = {
        "abha_id": t.recovered_id(F.col("abha_id").cast("string"), F.col("_all")),
        "patient_name": t.recovered_name(F.col("patient_name").cast("string"), F.col("_all")),
    }
    return df.withColumn("_all", everything).select(
        *[recovered.get(f, F.col(f).cast("string")).alias(f) for f in v.INTAKE_V1_FIELDS]
    )


def canonical_first(df: DataFrame, fields: Iterable[str] = v.ADAPTER_FIELDS) -> DataFrame:
    """Canonical columns in their order, then the others in theirs."""
    first = [f for f in fields if f in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


def drop_null_tokens(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Text columns as strings, with the written forms of null read as null."""
    chosen = list(columns) if columns is not None else df.columns
    return df.withColumns(
        {c: t.without_null_tokens(F.col(c).cast("string")) for c in chosen if c in df.columns}
    )


def manual_entries(df: DataFrame, as_of: datetime, consent: str = "ACTIVE") -> DataFrame:
    """Complete hand-typed records: an id derived from the content, today's date, given consent."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    return canonical_rename(
        df.withColumns(
            {
                "notice_id": F.sha2(F.concat_ws("|", *parts), 256),
                "notice_date": F.lit(as_of.date().isoformat()),
                "consent_status": F.lit(consent),
                "data_purpose": F.lit("Manual Entry"),
            }
        )
    )

"""Alias-driven mapping of unknown headers: exact lookup, fuzzy suggestion, batch standardising.

The alias table is a fixed list of header spellings (below a thousand) whatever the data, so it is inlined as a
literal.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardgate.functions import text as t
from wardgate.functions import vocab as v

ACCEPT_ABOVE = 0.3


@cache
def alias_rows() -> tuple[tuple[str, str, int], ...]:
    """(alias, canonical field, order)."""
    pairs = [(a, field) for field, names in v.HEADER_ALIASES.items() for a in names]
    return tuple((a, field, i) for i, (a, field) in enumerate(pairs))


FIELD_ORDER = tuple(dict.fromkeys(c for _, c, _ in alias_rows()))


def resolve_name(name: str) -> str:
    """Canonical field of one header of an open batch, or the header itself."""
    known = {a: c for a, c, _ in alias_rows()}
    low = name.strip().lower()
    return known.get(low) or known.get(low.replace(" ", "_").replace("-", "_")) or name


# --- header tables ----------------------------------------------------------------------------


def header_key_sql(name: str) -> str:
    """The spelling of a header expression that is looked up, as SQL text.

    Every alias with a space has its underscore twin, so the underscore spelling alone is looked up.
    """
    return f"translate(lower(trim({name})), ' -', '__')"


def field_of_key_sql(key: str) -> str:
    """Canonical field of a key expression, null when none is known: one hash-set test per field, and no join."""
    whens = []
    for field in FIELD_ORDER:
        names = [a for a, c, _ in alias_rows() if c == field and " " not in a]
        whens.append(f"WHEN {key} IN ({', '.join(repr(a) for a in names)}) THEN '{field}'")
    return f"CASE {' '.join(whens)} END"


def canonical_name_sql(name: str) -> str:
    """Canonical field of a header expression, null when none is known, as SQL text."""
    return field_of_key_sql(header_key_sql(name))


def canonical_name(column: str) -> Column:
    return F.expr(canonical_name_sql(column))


def resolve_headers(headers: DataFrame, column: str = "column_name") -> DataFrame:
    """Add ``canonical``: the field a header stands for, or the header when none is known."""
    return headers.withColumn("canonical", F.coalesce(canonical_name(column), column))


ALIAS_LITERAL = "array<struct<ord:int,alias:string,chars:array<string>,words:array<string>>>"


def _aliases_of(field: str) -> Column:
    """The field's aliases with their character and word sets, as a constant."""
    rows = [
        {"ord": o, "alias": a, "chars": sorted(set(a)), "words": sorted(set(a.split("_")))}
        for a, c, o in alias_rows()
        if c == field
    ]
    return F.from_json(F.lit(json.dumps(rows)), ALIAS_LITERAL)


def _best_of(field: str) -> Column:
    """The field's best alias for the header at hand, as a struct that orders by merit."""

    def scored(alias: Column) -> Column:
        score = t.similarity_of_sets(
            F.col("_h"), F.col("_chars"), F.col("_words"),
            alias["alias"], alias["chars"], alias["words"],
        )
        return F.struct(
            score.alias("score"),
            F.lit(-FIELD_ORDER.index(field)).alias("neg_field"),
            (-alias["ord"]).alias("neg_ord"),
            F.lit(field).alias("canonical"),
            alias["alias"].alias("alias"),
        )

    return F.array_max(F.transform(_aliases_of(field), scored))


def _ranked(headers: DataFrame, column: str) -> tuple[DataFrame, Column]:
    """(distinct headers, their fields by merit).

    Ties go to the field, and within a field to the alias, that comes first.  Distinct headers are
    few whatever the number of rows; each is scored against the constant alias lists where it
    stands, so there is no join, no exploded pair and no further shuffle.
    """
    tasks = int(headers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = (
        headers.select(column)
        .filter(F.col(column) != "")
        .distinct()
        .repartition(tasks)  # few rows, much work per row
        .withColumn("_h", F.trim(t.header_key(F.col(column))))
        .withColumns(
            {
                "_chars": F.array_distinct(F.split("_h", "")),
                "_words": F.array_distinct(F.split("_h", "_")),
            }
        )
    )
    return distinct, F.sort_array(F.array(*[_best_of(f) for f in FIELD_ORDER]), asc=False)


def top_candidates(headers: DataFrame, column: str = "column_name", k: int = 3) -> DataFrame:
    """The ``k`` best fields per distinct header, each with its best alias."""
    distinct, ranked = _ranked(headers, column)
    rows = F.transform(
        F.slice(ranked, 1, k),
        lambda x, i: F.struct(
            (i + 1).alias("rank"), x["canonical"].alias("canonical"), x["score"].alias("score"),
            x["alias"].alias("alias"),
        ),
    )
    return distinct.select(column, F.inline(rows))


def suggest_fields(headers: DataFrame, column: str = "column_name") -> DataFrame:
    """One row per header: best field, score, whether to accept it, and the runners-up."""
    distinct, ranked = _ranked(headers, column)
    row = F.transform(
        F.array(ranked),  # one element, so that the ranking is bound once
        lambda x: F.struct(
            x[0]["canonical"].alias("suggested"),
            x[0]["score"].alias("score"),
            (x[0]["score"] > ACCEPT_ABOVE).alias("accepted"),
            F.concat_ws(",", x[1]["canonical"], x[2]["canonical"]).alias("alternatives"),
        ),
    )
    return distinct.select(column, F.inline(row))


def mapping_gaps(
    headers: DataFrame,
    source: str = "source_id",
    column: str = "column_name",
    position: str = "position",
) -> DataFrame:
    """Required fields no header of a source satisfies, with the first header that names the field."""
    required = F.explode(F.array(*[F.lit(f) for f in v.REQUIRED_FIELDS])).alias("required_field")
    spelled = F.lower(F.col(column))
    synonyms = {s: f for f, names in v.INTAKE_V1_SYNONYMS.items() for s in names}
    canonical = F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv])
    field = F.coalesce(F.try_element_at(canonical, spelled), spelled)
    return (
        headers.select(source, column, position, field.alias("_field"), required)
        .groupBy(source, "required_field")
        .agg(
            F.bool_or(F.col("_field") == F.col("required_field")).alias("_met"),
            F.min_by(
                F.when(F.contains(F.lower(column), F.col("required_field")), F.col(column)),
                F.when(F.contains(F.lower(column), F.col("required_field")), F.col(position)),
            ).alias("best_guess"),
        )
        .filter(~F.col("_met"))
        .drop("_met")
    )


# --- batches ----------------------------------------------------------------------------------


def standardize(
    df: DataFrame, unknown: str = "drop", overrides: Mapping[str, str] | None = None
) -> DataFrame:
    """Adapter record from any batch.

    Known headers are renamed, the last of several claiming one field wins; unknown ones are
    dropped or kept as ``UNMAPPED_<header>``; absent fields become null.
    """
    if unknown not in ("drop", "keep"):
        raise ValueError("unknown must be 'drop' or 'keep'")
    overrides = overrides or {}
    plan: dict[str, str] = {}
    for c in df.columns:
        field = overrides.get(c) or resolve_name(c)
        # The purpose has no alias: only its display name is recognised.
        known = field in v.ADAPTER_FIELDS[:-1] or field == v.CANONICAL["data_purpose"]
        if known or c in overrides:
            plan[field.lower()] = c
        elif unknown == "keep":
            plan[f"UNMAPPED_{c}"] = c
    chosen = [F.col(f"`{c}`").alias(out) for out, c in plan.items()]
    missing = [F.lit(None).cast(T.StringType()).alias(f) for f in v.ADAPTER_FIELDS if f not in plan]
    return df.select(*chosen, *missing)

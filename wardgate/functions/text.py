"""Column expressions over names, headers and report text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardgate.functions import vocab as v

WHITESPACE = " \t\n\r\x0b\x0c"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def first_match(text: Column, patterns: Iterable[str]) -> Column:
    """First group of the first pattern that matches; every pattern's group is non-empty."""
    groups = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns]
    return F.coalesce(*groups)


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def amount(raw: Column) -> Column:
    """Number, or zero when there is none."""
    return F.coalesce(raw.try_cast("double"), F.lit(0.0))


def without_null_tokens(text: Column, tokens: Iterable[str] = ("nan", "None")) -> Column:
    return F.when(~text.isin(*tokens), text)


def header_key(name: Column) -> Column:
    """Header as the alias table spells it: trimmed, lower case, words joined by underscores."""
    return F.translate(F.lower(F.trim(name)), " -", "__")


def similarity(a: Column, b: Column) -> Column:
    """1 when equal, 0.8 when one holds the other, else the mean of two set overlaps.

    The overlaps are the Jaccard indices of the character sets and of the ``_``-separated words.
    """
    a, b = F.lower(F.trim(a)), F.lower(F.trim(b))
    sets = [F.array_distinct(F.split(x, s)) for x in (a, b) for s in ("", "_")]
    return similarity_of_sets(a, sets[0], sets[1], b, sets[2], sets[3])


def similarity_of_sets(
    a: Column, a_chars: Column, a_words: Column, b: Column, b_chars: Column, b_words: Column
) -> Column:
    """As :func:`similarity`, for prepared strings whose sets are at hand."""

    def overlap(x: Column, y: Column) -> Column:
        common = F.size(F.array_intersect(x, y))
        return common / (F.size(x) + F.size(y) - common)

    return (
        F.when(a == b, 1.0)
        .when(F.contains(a, b) | F.contains(b, a), 0.8)
        .otherwise(overlap(a_chars, b_chars) * 0.5 + overlap(a_words, b_words) * 0.5)
    )


def recovered_id(id_: Column, everything: Column) -> Column:
    """A missing id is looked for in all the record's text."""
    found = F.nullif(F.regexp_extract(everything, v.RECOVER_ID, 0), F.lit(""))
    return F.when(
        F.coalesce(id_ == "", F.lit(True)),
        F.coalesce(F.replace(found, F.lit(" "), F.lit("-")), id_),
    ).otherwise(id_)


def recovered_name(name: Column, everything: Column) -> Column:
    """A missing, redacted or generated name is looked for in all the record's text."""
    found = F.nullif(F.regexp_extract(everything, v.RECOVER_NAME, 1), F.lit(""))
    lacking = (
        F.coalesce(name == "", F.lit(True))
        | (name == "Unknown/Redacted")
        | name.contains("AUTO_Patient_Name")
    )
    return F.when(lacking, F.coalesce(found, name)).otherwise(name)

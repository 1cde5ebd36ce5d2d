"""Column expressions that hide, tokenise or redact personal data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardgate.functions import vocab as v


def is_blank(text: Column) -> Column:
    """Null or only whitespace."""
    return F.coalesce(F.trim(text) == "", F.lit(True))


def id_token(identifier: Column) -> Column:
    """Stable token of an identifier that does not reveal it."""
    hashed = F.concat(F.substring(F.sha2(identifier, 256), 1, 8), F.lit("****"))
    return F.when(identifier.isNull() | identifier.isin(*v.NO_TOKEN), "****").otherwise(hashed)


def pseudonym(value: Column, prefix: str) -> Column:
    """Prefixed token; empty and already redacted values stay as they are."""
    keep = value.isNull() | value.isin("", "REDACTED")
    return F.when(keep, value).otherwise(F.concat(F.lit(prefix), id_token(value)))


def _is_unnamed(value: Column) -> Column:
    return is_blank(value) | value.isin("None", "Unknown/Redacted")


def mask_short(value: Column) -> Column:
    """Two characters at each end, fewer for short values."""
    return (
        F.when(_is_unnamed(value), v.MISSING_REDACTED)
        .when(F.length(value) < 4, "****")
        .when(F.length(value) == 4, F.concat(F.left(value, F.lit(1)), F.lit("****")))
        .otherwise(
            F.concat(F.left(value, F.lit(2)), F.lit("****"), F.right(value, F.lit(2)))
        )
    )


def mask_name(value: Column) -> Column:
    """First and last character only; generated names keep their number."""
    inner = F.repeat(F.lit("*"), F.length(value) - 2)
    return (
        F.when(_is_unnamed(value), v.MISSING_REDACTED)
        .when(
            value.startswith("Patient_"),
            F.concat(F.lit("P********_"), F.substring(value, len("Patient_") + 1, 2147483647)),
        )
        .when(F.length(value) < 4, "****")
        .otherwise(F.concat(F.left(value, F.lit(1)), inner, F.right(value, F.lit(1))))
    )


def mask_id(value: Column) -> Column:
    """Both ends of an identifier; fourteen bare digits keep the card layout."""
    packed = F.replace(value, F.lit(" "), F.lit(""))
    return (
        F.when(is_blank(value) | (value == "None"), v.MISSING_ID)
        .when(
            packed.rlike(v.ID_DIGITS),
            F.concat(
                F.left(packed, F.lit(2)), F.lit(" XXXX XXXX "), F.right(packed, F.lit(4))
            ),
        )
        .when(
            F.length(packed) > 4,
            F.concat(F.left(packed, F.lit(2)), F.lit(" XXXX "), F.right(packed, F.lit(2))),
        )
        .otherwise("****")
    )


def mask_payload(value: Column) -> Column:
    return F.when(is_blank(value), v.EMPTY_PAYLOAD).otherwise(v.PROTECTED_PAYLOAD)


def redact_text(text: Column) -> Column:
    """Replace emails, health ids, phone and national numbers by labels, in that order.

    Every email holds an ``@`` and every health id a ``-``: text without one skips that pattern.
    """
    for label, pattern in v.REDACTIONS.items():
        replaced = F.regexp_replace(text, F.lit(pattern), F.lit(f"[REDACTED_{label}]"))
        sign = v.REDACTION_SIGNS.get(label)
        text = F.when(text.contains(sign), replaced).otherwise(text) if sign else replaced
    return text


def ledger_line(
    event_ts: Column, action: Column, subject: Column, reason: Column, outcome: Column
) -> Column:
    """One governance ledger entry as text, with personal data redacted."""
    line = F.format_string(
        "[%s] [GOVERNANCE] %s on %s: %s -> %s",
        F.date_format(event_ts, "yyyy-MM-dd'T'HH:mm:ss"),
        action,
        subject,
        reason,
        outcome,
    )
    return redact_text(line)

"""Column expressions behind the disposition rules: identifiers, evidence, dates and consent."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardgate.functions import vocab as v


def moment(value: datetime | str) -> Column:
    """A fixed point in time, independent of the session time zone."""
    text = value.isoformat(sep=" ") if isinstance(value, datetime) else value
    return F.lit(text).cast("timestamp_ntz")


def cutoff(as_of: datetime, days: int) -> Column:
    return moment(as_of - timedelta(days=days))


def is_true(cond: Column) -> Column:
    """Two-valued condition: unknown counts as false."""
    return F.coalesce(cond, F.lit(False))


# --- identifiers ------------------------------------------------------------------------------


def id_digits(raw: Column) -> Column:
    """The identifier without hyphens; empty when there is none."""
    return F.replace(F.coalesce(raw.cast("string"), F.lit("")), F.lit("-"), F.lit(""))


def id_is_valid(raw: Column) -> Column:
    """Is the identifier well-formed once normalised?  Exactly when it holds fourteen digits."""
    return id_digits(raw).rlike(v.ID_DIGITS)


def hyphenated(digits: Column) -> Column:
    cuts = ((1, 2), (3, 4), (7, 4), (11, 4))
    return F.concat_ws("-", *[F.substring(digits, a, n) for a, n in cuts])


def normalized_id(raw: Column, valid: Column | None = None) -> Column:
    """Null becomes empty; fourteen digits in any hyphenation become NN-NNNN-NNNN-NNNN."""
    return F.when(id_is_valid(raw) if valid is None else valid, hyphenated(id_digits(raw))).otherwise(
        F.coalesce(raw.cast("string"), F.lit(""))
    )


def id_is_hyphenated(id_: Column) -> Column:
    return is_true(id_.rlike(v.ID_HYPHENATED))


def id_is_digits(id_: Column) -> Column:
    return is_true(id_.rlike(v.ID_DIGITS))


def id_is_missing(id_: Column) -> Column:
    return F.coalesce(id_ == "", F.lit(True))


def id_is_accepted_v1(id_: Column) -> Column:
    return is_true(id_.rlike(v.ID_V1))


def notice_is_versioned(notice_id: Column) -> Column:
    return is_true(notice_id.rlike(v.NOTICE_VERSIONED))


def notice_is_legacy(notice_id: Column) -> Column:
    return is_true(notice_id.startswith(v.LEGACY_NOTICE_PREFIX))


# --- evidence ---------------------------------------------------------------------------------


def names_clinical_term(lower: str) -> Column:
    """Does a lower-case text expression name a term?  Substring tests cost a fraction of one
    alternation pattern and stop at the first hit."""
    return F.expr(" OR ".join(f"contains({lower}, '{term}')" for term in v.EVIDENCE_TERMS))


def denies_evidence(payload: Column) -> Column:
    """The look-ahead skips positions at which no phrase can begin."""
    return payload.rlike(f"(?i)(?=[{v.NO_EVIDENCE_INITIALS}]){v.NO_EVIDENCE_ALTERNATIVES}")


def has_clinical_evidence(payload: str, lower: str | None = None) -> Column:
    """Long enough, not denied by a phrase, and naming at least one clinical term.

    ``payload`` names a column, and ``lower`` the same text in lower case where an earlier
    projection has it.
    """
    return is_true(
        (F.length(payload) >= v.MIN_EVIDENCE_CHARS)
        & names_clinical_term(lower or f"lower({payload})")
        & ~denies_evidence(F.col(payload))
    )


# --- dates ------------------------------------------------------------------------------------

# Written forms of a date that are understood besides ISO, month first when ambiguous.
LENIENT_DATE_FORMATS = (
    "yyyy/MM/dd",
    "yyyyMMdd",
    "MM-dd-yyyy",
    "MM/dd/yyyy",
    "dd-MM-yyyy",
    "dd/MM/yyyy",
    "d MMM yyyy",
)


def strict_date(text: Column, as_of: datetime) -> Column:
    """ISO day at midnight; anything else counts as given at ``as_of``."""
    day = F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
    return F.coalesce(day.cast("timestamp_ntz"), moment(as_of))


def lenient_timestamp(text: Column) -> Column:
    """Any understood written form; null when none fits."""
    iso = F.when(text.rlike(r"^\s*[0-9]{4}-[0-9]{2}-[0-9]{2}"), text.try_cast("timestamp_ntz"))
    others = [F.try_to_date(F.trim(text), f).cast("timestamp_ntz") for f in LENIENT_DATE_FORMATS]
    return F.coalesce(iso, *others)


def is_expired(text: Column, as_of: datetime, days: int) -> Column:
    return is_true(lenient_timestamp(text) < cutoff(as_of, days))


# --- consent ----------------------------------------------------------------------------------


def is_revoked(consent: Column) -> Column:
    return is_true(consent == "REVOKED")


def is_revoked_any_case(consent: Column) -> Column:
    return is_true(F.upper(consent) == "REVOKED")


def purpose_is_unauthorized(purpose: Column) -> Column:
    """A purpose that is given and is not one of the allowed ones."""
    stated = F.coalesce(F.nullif(purpose, F.lit("")), F.lit("UNKNOWN"))
    return ~stated.isin(*v.ALLOWED_PURPOSES)


def erasure_reason(
    consent: Column, notice_date: Column, purpose: Column | None, as_of: datetime, days: int
) -> Column:
    """Why a record must go, or ``N/A``; without ``purpose`` only consent and age count."""
    reason = F.when(is_revoked_any_case(consent), "CONSENT_REVOKED").when(
        is_expired(notice_date, as_of, days), "NOTICE_EXPIRED"
    )
    if purpose is not None:
        reason = reason.when(purpose_is_unauthorized(purpose), "UNAUTHORIZED_PURPOSE")
    return reason.otherwise("N/A")


def erasure_outcome(reason: Column, consent: Column) -> Column:
    return (
        F.when(reason != "N/A", F.concat(F.lit("PURGED_"), reason))
        .when(consent.isin(*v.LINKABLE_CONSENT), "SUCCESS_LINKED")
        .otherwise("QUARANTINED_PENDING")
    )

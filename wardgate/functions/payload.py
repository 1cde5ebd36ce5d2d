"""Column expressions over the clinical payload, a JSON object or free text inside a string."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardgate.functions import vocab as v

KEY_VALUES = "map<string,string>"


def json_object(text: Column) -> Column:
    """Top-level members of a JSON object; null when the text is not one object."""
    whole = F.when(F.rtrim(text).endswith("}"), text)
    return F.from_json(whole, KEY_VALUES)


def payload_object(payload: Column) -> Column:
    """As :func:`json_object`, for payloads that may use single quotes."""
    return json_object(F.replace(payload, F.lit("'"), F.lit('"')))


def member(obj: Column, key: str, default: str) -> Column:
    """A member's value; the default applies when the key or the whole object is absent."""
    return F.when(F.map_contains_key(obj, key), F.try_element_at(obj, F.lit(key))).otherwise(
        default
    )


def diagnosis(obj: Column) -> Column:
    return member(obj, "diagnosis", "")


def visit_type(obj: Column) -> Column:
    return member(obj, "visit_type", "UNKNOWN")


def visit_type_with_fallback(obj: Column, payload: Column) -> Column:
    """An unknown visit type is read off the raw text."""
    stated = visit_type(obj)
    found = F.lit(None).cast("string")
    for kind in reversed(v.VISIT_TYPES):
        found = F.when(payload.contains(kind), kind).otherwise(found)
    return F.when(stated == "UNKNOWN", F.coalesce(found, stated)).otherwise(stated)


def snomed_code(text: Column, default: str) -> Column:
    """Code of a clinical text; the terminology has a fixed, small size."""
    codes = F.create_map(*[F.lit(x) for x in chain(*v.SNOMED.items())])
    return F.coalesce(F.try_element_at(codes, text), F.lit(default))


def condition_text(payload: Column) -> Column:
    """Diagnosis named by the payload; unreadable payloads speak for themselves."""
    obj = json_object(payload)
    return F.when(obj.isNull(), F.coalesce(payload, F.lit("None"))).otherwise(
        member(obj, "diagnosis", "Unknown Condition")
    )


PATIENT_SHAPE = "struct<resourceType:string,name:array<map<string,string>>>"


def patient_resource_is_named(resource_json: Column, others_pass: bool = True) -> Column:
    """Does a Patient resource carry ``name[0].text``?  Other resources pass or fail as asked."""
    res = F.from_json(resource_json, PATIENT_SHAPE)
    named = F.coalesce(F.map_contains_key(F.try_element_at(res["name"], F.lit(1)), "text"), F.lit(False))
    is_patient = F.coalesce(res["resourceType"] == "Patient", F.lit(False))
    return F.when(is_patient, named).otherwise(others_pass)

"""Importing this module registers every query."""

from wardgate.plans import (  # noqa: F401
    cases_flows,
    cases_formats,
    cases_landing,
    cases_mapping,
    cases_metrics,
    cases_rules,
    cases_store,
)

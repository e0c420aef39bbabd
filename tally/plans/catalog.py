"""Imports every catalogue module so the registry is complete."""
from tally.plans import queries_aml, queries_audit, queries_ledger, queries_misc, queries_stream  # noqa: F401
from tally.plans.registry import ORACLE, QUERIES  # noqa: F401

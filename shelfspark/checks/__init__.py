"""Registered queries and the SQL each one is checked against."""

import importlib

FAMILIES = ["traffic", "search", "cleaning", "ingest", "dedup", "profiles", "streams"]


def load():
    """Import every family and return (queries, oracle SQL)."""
    from shelfspark.checks.registry import ORACLES, QUERIES

    for family in FAMILIES:
        importlib.import_module(f"shelfspark.checks.{family}")
    return QUERIES, ORACLES

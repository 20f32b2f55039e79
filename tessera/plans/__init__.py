"""Registered queries: each applies an operator to the driver tables, with the same query in DuckDB SQL."""

from tessera.plans import curation, evaluation, files, relational, reports, stores, telemetry, texts  # noqa: F401
from tessera.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

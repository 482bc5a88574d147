"""Every registered query, by the modules that define them."""

from __future__ import annotations

from . import audit_queries, cohort_queries, kernel_queries, manifest_queries, model_queries, profile_queries, split_queries  # noqa: F401
from .catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

"""All registered queries. Importing a query module registers what it defines."""

from __future__ import annotations

from sieveline.plans import feature_queries, table_queries, text_queries, triage_queries  # noqa: F401
from sieveline.plans.registry import ORACLE, QUERIES
from sieveline.plans.triage_queries import flagship

__all__ = ["ORACLE", "QUERIES", "flagship"]

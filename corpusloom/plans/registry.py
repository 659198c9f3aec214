"""The queries over the test tables and the SQL that gives the same rows."""

from __future__ import annotations

from corpusloom.plans import contract_queries, dialogue_queries, duplicate_queries, governance_queries, linguistic_queries, sampling_queries, source_queries, stat_queries, table_queries, text_queries
from corpusloom.plans.catalog import QUERIES, SQL
from corpusloom.plans.duplicate_queries import duplicate_summary as flagship

__all__ = ["QUERIES", "SQL", "flagship", "contract_queries", "dialogue_queries", "duplicate_queries", "governance_queries", "linguistic_queries", "sampling_queries", "source_queries", "stat_queries", "table_queries", "text_queries"]

"""All queries of this package and their SQL."""

from __future__ import annotations

from opsloom.plans import allocation_queries, composite_queries, list_queries, review_queries, rollup_queries, rulebook_queries, text_queries, workflow_queries

_MODULES = (rollup_queries, allocation_queries, text_queries, workflow_queries, composite_queries, review_queries, rulebook_queries, list_queries)

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: q for m in _MODULES for k, q in m.ORACLES.items()}

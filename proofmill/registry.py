"""All queries over the driver's tables, with the SQL that must give the same rows."""

from .plans import corpus_queries, evidence_queries, general_queries, source_queries

_PLANS = (corpus_queries, evidence_queries, general_queries, source_queries)
QUERIES = {name: f for plan in _PLANS for name, f in plan.QUERIES.items()}
ORACLE = {name: sql for plan in _PLANS for name, sql in plan.ORACLE.items()}

"""All core queries and their SQL twins, by name."""

from __future__ import annotations

from folioscope.plans import document_queries, evaluation_queries, integrity, retrieval_queries

_PARTS = (retrieval_queries, evaluation_queries, document_queries, integrity)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}

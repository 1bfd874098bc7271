"""The registered queries of the engine, each with its DuckDB SQL where SQL can say it."""

from __future__ import annotations

from lorevine.plans import ingest_queries, retrieval_queries, scoring_queries, search_queries

_MODULES = (retrieval_queries, scoring_queries, ingest_queries, search_queries)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}

"""All queries of the engine with their SQL, those of the llm subpackage apart."""

from __future__ import annotations

from . import more_queries, queries

QUERIES = {**queries.QUERIES, **more_queries.QUERIES}
ORACLE_SQL = {**queries.ORACLE_SQL, **more_queries.ORACLE_SQL, **more_queries.ROUTE_SQL}

"""All registered queries of the media and symbol-sequence jobs, with their SQL."""

from __future__ import annotations

from tessera.plans import media_queries, stream_queries

QUERIES = media_queries.QUERIES | stream_queries.QUERIES
ORACLE_SQL = media_queries.ORACLE_SQL | stream_queries.ORACLE_SQL

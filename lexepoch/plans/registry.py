"""Registered queries of the point-in-time operators and their oracles in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit_queries, corpus, incremental_queries, search_queries, source_queries, temporal_queries, text_queries, timeline_queries

_MODULES = (temporal_queries, text_queries, search_queries, audit_queries, source_queries, corpus, incremental_queries, timeline_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLE.items()}

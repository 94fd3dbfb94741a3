"""Registry of the engine's own queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import chunking, citations, embedding, evaluation, feedback, index, knowledge, mentions, retrieval, tagging, traversal, warehouse
from tessera.plans import queries as plan_queries
from tessera.plans import questions
from tessera.sources import queries as source_queries
from tessera.streaming import limiter, windows

MODULES = (warehouse, tagging, retrieval, index, knowledge, mentions, traversal, embedding, feedback, evaluation, citations, chunking, source_queries, questions, plan_queries, windows, limiter)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in MODULES for k, v in m.ORACLES.items()}

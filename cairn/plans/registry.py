"""All registered queries of the engine, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import code_queries, retrieval_queries, state_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**retrieval_queries.QUERIES, **code_queries.QUERIES, **state_queries.QUERIES}
ORACLES: dict[str, str] = {**retrieval_queries.ORACLES, **code_queries.ORACLES, **state_queries.ORACLES}

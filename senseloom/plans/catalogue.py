"""The catalogue of queries and of their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from senseloom.plans import corpus, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**corpus.QUERIES, **vectors.QUERIES}
ORACLES: dict[str, str] = {**corpus.ORACLES, **vectors.ORACLES}

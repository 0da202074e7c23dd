"""The core queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codestrata.plans import divergence, drift, findings, golden, graphs, hierarchy, measures, reports, sources, texts

MODULES = (measures, findings, graphs, divergence, drift, hierarchy, texts, sources, golden, reports)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in MODULES for k, v in m.QUERIES.items()}

"""Problem 5: do two tools' copies of the same measurements agree?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators.divergence import divergence, finite, finite_number
from codestrata.operators.latest import latest
from codestrata.tables import table

TOLERANCE = 0.000001  # fixed by the problem's statement


def same_symbol(symbol: Column) -> Column:
    """A symbol without surrounding white space and without a backslash directly after the first `::`."""
    trimmed = F.regexp_replace(symbol, r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(trimmed, r"^((?s:.*?)::)\\", "$1")


def measured(spark: SparkSession, folder: str, name: str, value: Column) -> DataFrame:
    rows = table(spark, folder, name).select(same_symbol(F.col("symbol")).alias("item"), F.col("metric").alias("field"), value.alias("value"), "measured_at")
    return latest(rows, ["item", "field"], ["measured_at"], ["value"])


def p5_differences(spark: SparkSession, folder: str) -> DataFrame:
    ours = measured(spark, folder, "qmx_values", finite(F.col("qmx_value")))
    others = measured(spark, folder, "other_values", finite_number(F.col("other_value")))
    found = divergence(ours, others, TOLERANCE)
    kind = F.when(F.col("kind") == "left_only", "qmx_only").when(F.col("kind") == "right_only", "other_only").otherwise(F.col("kind"))
    return found.select(
        F.col("item").alias("symbol"), kind.alias("kind"), F.coalesce("field", F.lit("")).alias("metric"), F.col("left_value").alias("qmx_value"), F.col("right_value").alias("other_value")
    )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_differences(spark, folder).select("symbol", "kind", "metric")


def p5_summary(spark: SparkSession, folder: str) -> DataFrame:
    """How many symbols are one-sided and how many values differ, by kind and metric."""
    return p5_differences(spark, folder).groupBy("kind", "metric").agg(F.count("*").alias("cases"))


_BASE = r"""
WITH q0 AS (SELECT regexp_replace(regexp_replace(symbol, '^\s+|\s+$', '', 'g'), '^((?s:.*?)::)\\', '\1') AS symbol, metric,
                   CASE WHEN isfinite(qmx_value) THEN qmx_value END AS v, measured_at FROM qmx_values),
o0 AS (SELECT regexp_replace(regexp_replace(symbol, '^\s+|\s+$', '', 'g'), '^((?s:.*?)::)\\', '\1') AS symbol, metric,
              CASE WHEN regexp_full_match(trim(other_value), '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?')
                   THEN TRY_CAST(ltrim(trim(other_value), '+') AS DOUBLE) END AS v, measured_at FROM other_values),
q AS (SELECT symbol, metric, v FROM q0 QUALIFY row_number() OVER (PARTITION BY symbol, metric ORDER BY measured_at DESC NULLS LAST, v DESC NULLS LAST) = 1),
o AS (SELECT symbol, metric, v FROM o0 QUALIFY row_number() OVER (PARTITION BY symbol, metric ORDER BY measured_at DESC NULLS LAST, v DESC NULLS LAST) = 1),
qs AS (SELECT DISTINCT symbol FROM q), os AS (SELECT DISTINCT symbol FROM o),
pairs AS (SELECT coalesce(q.symbol, o.symbol) AS symbol, coalesce(q.metric, o.metric) AS metric, q.v AS qmx_value, o.v AS other_value
          FROM q FULL JOIN o ON q.symbol = o.symbol AND q.metric = o.metric),
found AS (
  SELECT symbol, 'qmx_only' AS kind, '' AS metric, NULL::DOUBLE AS qmx_value, NULL::DOUBLE AS other_value FROM qs WHERE symbol NOT IN (SELECT symbol FROM os)
  UNION ALL SELECT symbol, 'other_only', '', NULL, NULL FROM os WHERE symbol NOT IN (SELECT symbol FROM qs)
  UNION ALL SELECT symbol, 'differs', metric, qmx_value, other_value FROM pairs
  WHERE symbol IN (SELECT symbol FROM qs) AND symbol IN (SELECT symbol FROM os)
    AND ((qmx_value IS NULL) <> (other_value IS NULL) OR abs(qmx_value - other_value) > 0.000001))
"""

QUERIES = {"p5_found": p5_found, "p5_differences": p5_differences, "p5_summary": p5_summary}
ORACLE = {
    "p5_found": _BASE + "SELECT symbol, kind, metric FROM found",
    "p5_differences": _BASE + "SELECT symbol, kind, metric, qmx_value, other_value FROM found",
    "p5_summary": _BASE + "SELECT kind, metric, count(*) AS cases FROM found GROUP BY ALL",
}

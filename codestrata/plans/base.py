"""Tables that several queries start from, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators.latest import latest
from codestrata.tables import table


def above(name: Column) -> Column:
    """A name without its last segment; '' if it has only one."""
    last = F.substring_index(name, "\\", -1)
    return F.when(F.length(name) > F.length(last), F.substring(name, F.lit(1), F.length(name) - F.length(last) - 1)).otherwise("")


def subjects(spark: SparkSession, folder: str) -> DataFrame:
    """The current row of each named symbol, with the class that it is or belongs to and its namespace."""
    rows = table(spark, folder, "symbols").where("name IS NOT NULL")
    mi = F.col("metrics.mi")
    mi = F.when(~F.isnan(mi) & (F.abs(mi) != float("inf")), mi)
    values = ["symbol_id", "file", "line", mi.alias("mi"), F.col("metrics.ccn").alias("ccn"), F.col("metrics.loc").alias("loc"), F.col("metrics.class_loc").alias("class_loc")]
    current = latest(rows, ["project", "type", "name"], ["collected_at", "symbol_id"], values)
    own = F.when(F.col("type") == "method", F.substring_index("name", "::", 1)).when(F.col("type") == "class", F.col("name"))
    with_class = current.withColumn("class_key", own)
    space = F.when(F.col("type") == "file", "").when(F.col("type") == "function", above(F.col("name"))).otherwise(above(F.col("class_key")))
    return with_class.withColumn("namespace", space)


SUBJECTS = r"""
WITH RECURSIVE cur0 AS (
  SELECT project, type, name, symbol_id, file, line, CASE WHEN isfinite(metrics.mi) THEN metrics.mi END AS mi, metrics.ccn AS ccn, metrics.loc AS loc, metrics.class_loc AS class_loc
  FROM symbols WHERE name IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY project, type, name ORDER BY collected_at DESC NULLS LAST, symbol_id DESC) = 1),
cur1 AS (SELECT *, CASE type WHEN 'method' THEN split_part(name, '::', 1) WHEN 'class' THEN name END AS class_key FROM cur0),
sub AS (SELECT *, CASE type WHEN 'file' THEN '' WHEN 'function' THEN regexp_extract(name, '^((?s:.*))\\[^\\]*$', 1)
                            ELSE regexp_extract(class_key, '^((?s:.*))\\[^\\]*$', 1) END AS namespace FROM cur1)
"""


def seven(value: str, prefix: str) -> str:
    """SQL of the seven aggregates, sums rounded to 6 digits, other doubles to 9."""
    return (
        f"round(sum({value})::DOUBLE, 6) AS {prefix}_sum, round(avg({value}), 9) AS {prefix}_avg, max({value})::DOUBLE AS {prefix}_max, min({value})::DOUBLE AS {prefix}_min, "
        f"count({value}) AS {prefix}_count, round(quantile_cont({value}::DOUBLE, 0.95), 9) AS {prefix}_p95, round(quantile_cont({value}::DOUBLE, 0.05), 9) AS {prefix}_p5"
    )


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded, sums to 6 digits at most, so that the order in which values were added up doesn't show."""
    return df.select(*[F.round(c, min(digits, 6) if c.endswith("_sum") else digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])

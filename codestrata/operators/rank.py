"""Sorting, ranking and summing up findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def severity_rank(level: Column) -> Column:
    """0 error, 1 warning, 2 info and everything else."""
    return F.when(level == "error", 0).when(level == "warning", 1).otherwise(2)


SORTS = {
    "severity": ("_sev", "file", "_line"), "file": ("file", "_line"), "file_severity": ("file", "_sev", "_line"), "rule": ("channel", "file", "_line"),
    "class": ("subject_key", "_sev", "file", "_line"), "namespace": ("namespace", "_sev", "file", "_line"),
}


def sort_findings(findings: DataFrame, mode: str = "severity") -> DataFrame:
    """One of six orders; a null line counts as 0, and channel and subject decide ties."""
    rows = findings.withColumns({"_sev": severity_rank(F.col("severity")), "_line": F.coalesce("line", F.lit(0))})
    return rows.orderBy(*SORTS[mode], "channel", "subject_key").drop("_sev", "_line")


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.agg(*[F.count_if(F.col("severity") == s).alias(f"{s}s") for s in ("error", "warning", "info")])


def debt(findings: DataFrame) -> DataFrame:
    """Minutes in total, per file and per rule in one pass: `scope` (total, file, rule), `name`, `minutes`, `findings`."""
    rows = findings.select("file", F.substring_index("channel", "#", 1).alias("rule"), "minutes")
    sets = rows.groupingSets([[F.col("file")], [F.col("rule")], []], "file", "rule").agg(F.sum("minutes").alias("minutes"), F.count("*").alias("findings"), F.grouping_id().alias("g"))
    scope = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "file").otherwise("rule")
    return sets.select(scope.alias("scope"), F.when(F.col("g") == 3, "").when(F.col("g") == 1, F.col("file")).otherwise(F.col("rule")).alias("name"), "minutes", "findings")


def impact(findings: DataFrame, ranks: DataFrame, k: int | None = None) -> DataFrame:
    """Findings by impact: rank of the class (else the project's median, else 0) * weight (error 3, warning 1, else 0) *
    minutes; the first `k`, ties by file, line, channel and subject.

    `findings` has `project` and `class_key`; `ranks` is `project`, `class`, `rank`, where NaN and infinite ranks count
    as missing.
    """
    finite = ranks.where("rank IS NOT NULL AND NOT isnan(rank) AND abs(rank) < double('infinity')")
    medians = finite.groupBy(F.col("project").alias("mp")).agg(F.percentile("rank", 0.5).alias("median"))
    r = finite.select(F.col("project").alias("rp"), F.col("class").alias("rc"), "rank")
    joined = findings.join(r, F.col("project").eqNullSafe(F.col("rp")) & (F.col("class_key") == F.col("rc")), "left").join(medians, F.col("project").eqNullSafe(F.col("mp")), "left")
    weight = F.when(F.col("severity") == "error", 3).when(F.col("severity") == "warning", 1).otherwise(0)
    out = joined.withColumn("impact", F.coalesce("rank", "median", F.lit(0.0)) * weight * F.col("minutes")).drop("rp", "rc", "mp", "rank", "median")
    if k is None:
        return out
    return out.orderBy(F.desc("impact"), F.asc_nulls_first("file"), F.coalesce("line", F.lit(0)), "channel", "subject_key").limit(k)


def contributors(long: DataFrame, directions: dict[str, str], n: int = 10) -> DataFrame:
    """The `n` worst subjects per metric of `long` (`metric`, `subject_key`, `value`), by each metric's direction."""
    sign = F.create_map(*[x for m, d in directions.items() for x in (F.lit(m), F.lit(-1.0 if d == "higher" else 1.0))])
    rows = long.where(F.col("metric").isin(*directions) & F.col("value").isNotNull() & ~F.isnan("value")).withColumn("_key", F.col("value") * sign[F.col("metric")])
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("metric").orderBy("_key", "subject_key")))
    return ranked.where(F.col("rank") <= n).drop("_key")


def worst(scores: DataFrame, score: str, n: int) -> DataFrame:
    """The `n` subjects of lowest score, ties by subject; null and NaN scores don't rank."""
    return scores.where(F.col(score).isNotNull() & ~F.isnan(score)).orderBy(score, "subject_key").limit(n)

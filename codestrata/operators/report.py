"""Summaries of scores and findings: labels, decompositions, drill-downs, grouping and truncation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.matching import namespace_matches
from codestrata.operators.policy import identity


def score_label(score: Column, warning: float, error: float) -> Column:
    """Excellent, Good, Fair (above the warning), Poor (above the error) or Critical; null for a null score."""
    room = 100 - warning
    label = F.when(score > warning + room * 0.6, "Excellent").when(score > warning + room * 0.3, "Good").when(score > warning, "Fair").when(score > error, "Poor").otherwise("Critical")
    return F.when(score.isNotNull(), label)


def health_summary(scores: DataFrame, keys: list[str], weights: Mapping[str, float], thresholds: Mapping[str, tuple[float, float]], missing: float = 75) -> DataFrame:
    """Keys, `dimension`, `score`, `label`, `weight`, and `loss`: how many points of the overall score a dimension costs.

    `scores` has a column health__<dimension> of each of `weights`, and health__overall. A missing score counts as
    `missing` in the overall one; its label is null.
    """
    rows = []
    for name in [*weights, "overall"]:
        score = F.col(f"health__{name}")
        loss = F.lit(weights[name]) * (100 - F.coalesce(score, F.lit(missing))) if name in weights else F.lit(None)
        rows.append(F.struct(F.lit(name).alias("dimension"), score.alias("score"), score_label(score, *thresholds[name]).alias("label"), F.lit(weights.get(name)).cast("double").alias("weight"), loss.cast("double").alias("loss")))
    return scores.select(*keys, F.explode(F.array(*rows)).alias("d")).select(*keys, "d.*")


def drill_down(rows: DataFrame, namespace: str | None = None, class_key: str | None = None) -> DataFrame:
    """Rows (`namespace`, `class_key`) of one namespace and below (or a glob), or of one class; all without either. What is
    about the project has neither and is left out of both."""
    if namespace is not None:
        return rows.where(namespace_matches(F.col("namespace"), [namespace]))
    if class_key is not None:
        return rows.where(F.col("class_key") == class_key.strip("\\"))
    return rows


def by_file(findings: DataFrame) -> DataFrame:
    """One row per file: `findings`, `errors`, `minutes`, and `first`, the channel of its first finding by line, channel and
    subject. Findings without a file are one row with a null file. Nothing is gathered, so a file may have any number."""
    first = F.min_by("channel", F.struct(F.coalesce("line", F.lit(0)), "channel", "subject_key"))
    return findings.groupBy("file").agg(F.count("*").alias("findings"), F.count_if(F.col("severity") == "error").alias("errors"), F.sum("minutes").alias("minutes"), first.alias("first"))


def truncated(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first `limit` rows in an order, with `total` rows, `truncated`, and `more`, how many are left out."""
    total = rows.agg(F.count("*").alias("total"))
    shown = rows.orderBy(*order).limit(limit).crossJoin(F.broadcast(total))  # one row
    return shown.withColumn("truncated", F.col("total") > limit).withColumn("more", F.greatest(F.col("total") - limit, F.lit(0)))


def identity_order(findings: DataFrame) -> DataFrame:
    """Findings with `position`, their place in the order of identity, file and line: what makes two reports comparable.

    The order is a distributed sort; places are numbered by its partitions, so no task holds more than its range.
    """
    ordered = findings.withColumn("_id", identity(findings)).orderBy("_id", "file", F.coalesce("line", F.lit(0)), "value").withColumn("_n", F.monotonically_increasing_id())
    marked = ordered.withColumn("_p", F.shiftright("_n", 33)).withColumn("_i", F.col("_n").bitwiseAND(F.lit((1 << 33) - 1)))
    from codestrata.session import cut

    written = cut(marked)
    sizes = written.groupBy(F.col("_p").alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()  # one row a partition
    before, at = 0, [(-1, 0)]
    for r in sizes:
        at.append((r["p"], before))
        before += r["n"]
    starts = findings.sparkSession.createDataFrame(at, "p long, start long")
    out = written.join(F.broadcast(starts), F.col("_p") == F.col("p")).withColumn("position", F.col("start") + F.col("_i") + 1)
    return out.drop("_id", "_n", "_p", "_i", "p", "start")


def summary_lines(summary: DataFrame) -> DataFrame:
    """Lines of a health summary with a bar of ten marks: `value`, in the order of `project` and `dimension`."""
    marks = F.round(F.col("score") / 10).cast("int")
    bar = F.concat(F.repeat(F.lit("#"), marks), F.repeat(F.lit("."), 10 - marks))
    line = F.concat(F.col("project"), F.lit(" "), F.rpad("dimension", 15, " "), F.lit(" ["), bar, F.lit("] "), F.format_string("%.1f", "score"), F.lit(" "), F.col("label"))
    return summary.select(line.alias("value"))

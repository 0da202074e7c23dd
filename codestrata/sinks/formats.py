"""Reports as DataFrames of text or JSON lines; write them with `write.text`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def findings_json(findings: DataFrame) -> DataFrame:
    """One JSON object per finding, sorted keys given by the columns; null fields are left out."""
    return findings.select(F.to_json(F.struct(*sorted(findings.columns))).alias("value"))


def metrics_map(long: DataFrame, keys: list[str]) -> DataFrame:
    """Per subject a map of its metrics; NaN and infinite values become null, names with a colon are dropped."""
    value = F.when(~F.isnan("value") & (F.abs("value") != float("inf")), F.col("value"))
    rows = long.where(~F.contains(F.col("metric"), F.lit(":"))).groupBy(*keys, "metric").agg(F.max(value).alias("value"))
    return rows.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("metrics"))


def text_lines(findings: DataFrame) -> DataFrame:
    line = F.format_string("%s:%d: %s [%s] %s", F.coalesce("file", F.lit("(project)")), F.coalesce("line", F.lit(0)), "severity", "channel", F.coalesce("subject_key", F.lit("")))
    return findings.select(line.alias("value"))


def github_lines(findings: DataFrame) -> DataFrame:
    """Workflow annotations; line breaks, carriage returns and percent signs are escaped."""
    kind = F.when(F.col("severity") == "error", "error").when(F.col("severity") == "warning", "warning").otherwise("notice")
    message = F.concat_ws(" ", "channel", "subject_key")
    for raw, escaped in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")):
        message = F.replace(message, F.lit(raw), F.lit(escaped))
    return findings.select(F.format_string("::%s file=%s,line=%d::%s", kind, F.coalesce("file", F.lit("")), F.coalesce("line", F.lit(1)), message).alias("value"))


def fingerprint(findings: DataFrame):
    """md5 of channel, subject and what else tells findings apart."""
    have = [c for c in ("channel", "subject_key", "occ_key", "dep_type", "dep_target") if c in findings.columns]
    return F.md5(F.concat_ws(":", *[F.col(c) for c in have]))


def gitlab(findings: DataFrame) -> DataFrame:
    level = F.when(F.col("severity") == "error", "critical").when(F.col("severity") == "warning", "major").otherwise("info")
    where = F.struct(F.coalesce("file", F.lit("")).alias("path"), F.struct(F.coalesce("line", F.lit(1)).alias("begin")).alias("lines"))
    row = F.struct(F.concat_ws(" ", "channel", "subject_key").alias("description"), F.col("channel").alias("check_name"), fingerprint(findings).alias("fingerprint"), level.alias("severity"), where.alias("location"))
    return findings.select(F.to_json(row).alias("value"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """SARIF 2.1 results, one JSON object each; `sarif_rules` has the rules in the same order of names."""
    level = F.when(F.col("severity").isin("error", "warning"), F.col("severity")).otherwise("note")
    place = F.struct(F.struct(F.struct(F.coalesce("file", F.lit("")).alias("uri")).alias("artifactLocation"), F.struct(F.coalesce("line", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    row = F.struct(
        F.col("channel").alias("ruleId"), level.alias("level"), F.struct(F.concat_ws(" ", "channel", "subject_key").alias("text")).alias("message"),
        F.struct(fingerprint(findings).alias("primary")).alias("fingerprints"), F.array(place).alias("locations"),
    )
    return findings.select(F.to_json(row).alias("value"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    return findings.select("channel").distinct().select(F.to_json(F.struct(F.col("channel").alias("id"), F.struct(F.col("channel").alias("text")).alias("shortDescription"))).alias("value"))


def _xml(column):
    out = column
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return out


def checkstyle(findings: DataFrame) -> DataFrame:
    """One <file> element per file with its <error>s in order of lines; wrap them in <checkstyle>."""
    error = F.format_string('<error line="%d" severity="%s" message="%s" source="%s"/>', F.coalesce("line", F.lit(1)), "severity", _xml(F.coalesce("subject_key", F.lit(""))), _xml(F.col("channel")))
    rows = findings.select(F.coalesce("file", F.lit("(project)")).alias("file"), F.coalesce("line", F.lit(1)).alias("line"), error.alias("error"))
    files = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line", "error"))).alias("errors"))
    return files.select(F.concat(F.lit('<file name="'), _xml(F.col("file")), F.lit('">'), F.array_join(F.transform("errors", lambda e: e["error"]), ""), F.lit("</file>")).alias("value"))


def dot_lines(edges: DataFrame) -> DataFrame:
    """Lines of a graph in DOT from exported edges (`from`, `to`, `types`, `count`); wrap them in digraph { }."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return edges.select(F.concat(F.lit("  "), quote(F.col("from")), F.lit(" -> "), quote(F.col("to")), F.lit(" [label=\""), F.array_join("types", ","), F.lit("\"];")).alias("value"))


def graph_json(edges: DataFrame) -> DataFrame:
    return edges.select(F.to_json(F.struct("from", "to", "types", "count")).alias("value"))


def html_tree(classes: DataFrame) -> DataFrame:
    """Rows of a treemap: each namespace with the lines below it, its mean score weighted by lines, and its findings.

    `classes`: `project`, `namespace`, `loc`, `score`, `findings`.
    """
    from codestrata.operators.rollup import ancestors, weighted_mean

    spread = classes.select("project", F.explode(ancestors(F.col("namespace"))).alias("namespace"), "loc", "score", "findings")
    sums = spread.groupBy("project", "namespace").agg(F.sum("loc").alias("loc"), weighted_mean(F.col("score"), F.col("loc")).alias("score"), F.sum("findings").alias("findings"))
    return sums.withColumn("density", F.try_divide(F.col("findings").cast("double"), F.col("loc")))

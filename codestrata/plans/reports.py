"""Health summaries, drill-downs and reports of scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators import formula, rank, report, rules
from codestrata.operators.rollup import roll
from codestrata.plans import findings, graphs, measures
from codestrata.plans.base import SUBJECTS, rounded, subjects
from codestrata.session import cut
from codestrata.sinks import formats


def health_project(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of projects from all their callables, their classes' coupling, and the distance of their namespaces."""
    rows = subjects(spark, folder).where("type IN ('method', 'function')")
    raw = roll(rows, ["project"], ["ccn", "mi"], large=True)
    named = raw.select("project", *[F.col(f"{m}_{s}").cast("double").alias(f"{m}__{s}") for m in ("ccn", "mi") for s in ("sum", "avg", "max", "min", "p95", "p5")], F.col("ccn_count").cast("double").alias("symbolMethodCount"))
    coupled = roll(graphs.coupling_class(spark, folder), ["project"], ["cbo"], ["avg", "max", "p95"], large=True).select("project", *[F.col(f"cbo_{s}").alias(f"cbo__{s}") for s in ("avg", "max", "p95")])
    far = graphs.main_sequence(spark, folder).groupBy("project").agg(F.avg("distance").alias("distance__avg"))
    out = formula.compute(named.join(coupled, "project", "left").join(far, "project", "left"), formula.HEALTH_PROJECT)
    return rounded(out.select("project", *[c for c in out.columns if c.startswith("health__")]), 4)


def health_summary(spark: SparkSession, folder: str) -> DataFrame:
    scores = cut(health_project(spark, folder))  # a row a project; formulas aren't worked out again for each dimension
    return rounded(report.health_summary(scores, ["project"], formula.GROUP_WEIGHTS, formula.HEALTH_THRESHOLDS), 4)


def report_summary(spark: SparkSession, folder: str) -> DataFrame:
    return report.summary_lines(health_summary(spark, folder))


def computed_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of the health scores of namespaces."""
    rows = measures.health_namespace(spark, folder).select("*", F.concat_ws("::", F.lit("ns:"), "project", "namespace").alias("subject_key"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"))
    limits = {f"health.{d}": (w, e, True) for d, (w, e) in formula.HEALTH_THRESHOLDS.items()}
    return rules.computed_findings(rows, limits).select("channel", "subject_key", "severity", "value", "threshold")


def worst_namespaces(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 namespaces of lowest overall score among those with classes."""
    own = subjects(spark, folder).where("type = 'class' AND namespace <> ''").select("project", "namespace").distinct()
    scores = measures.health_namespace(spark, folder).join(own, ["project", "namespace"], "left_semi")
    return rank.worst(scores.withColumn("subject_key", F.concat_ws("::", "project", "namespace")), "health__overall", 20).select("subject_key", "health__overall")


def worst_in_namespace(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 worst classes of all namespaces named Domain and below."""
    from codestrata.plans.base import above

    scores = measures.health_class(spark, folder).withColumn("namespace", above(F.col("class_key"))).withColumn("subject_key", F.concat_ws("::", "project", "class_key"))
    return rank.worst(report.drill_down(scores, namespace="*\\Domain\\*"), "health__overall", 20).select("subject_key", "health__overall")


def findings_drill_down(spark: SparkSession, folder: str) -> DataFrame:
    return report.drill_down(findings._findings(spark, folder), namespace="*\\Domain\\*").groupBy("project", "namespace").agg(F.count("*").alias("findings"))


def findings_by_file(spark: SparkSession, folder: str) -> DataFrame:
    return report.by_file(findings._findings(spark, folder))


def top_issues(spark: SparkSession, folder: str) -> DataFrame:
    """The 25 findings of most overshoot, with how many more there are."""
    rows = findings._findings(spark, folder).withColumn("over", F.round(F.abs(F.col("value") - F.col("threshold")), 6))
    out = report.truncated(rows, [F.desc("over"), F.asc("channel"), F.asc("subject_key")], 25)
    return out.select("channel", "subject_key", "over", "total", "truncated", "more")


def identity_order(spark: SparkSession, folder: str) -> DataFrame:
    return report.identity_order(findings._findings(spark, folder)).select("channel", "subject_key", "position")


def report_graph_json(spark: SparkSession, folder: str) -> DataFrame:
    return formats.graph_json(graphs.edge_export(spark, folder))


QUERIES = {f.__name__: f for f in (health_project, health_summary, report_summary, computed_findings, worst_namespaces, worst_in_namespace, findings_drill_down, findings_by_file, top_issues, identity_order, report_graph_json)}

_HP = (
    SUBJECTS
    + f""", r AS (SELECT project, sum(ccn) AS cs, max(ccn) AS cm, quantile_cont(ccn::DOUBLE, 0.95) AS cp, count(ccn) AS n, avg(mi) AS ma, min(mi) AS mm, quantile_cont(mi, 0.05) AS mp FROM sub WHERE type IN ('method', 'function') GROUP BY ALL),
cc AS ({graphs.ORACLE["coupling_class"]}), ms AS ({graphs.ORACLE["main_sequence"]}),
cb AS (SELECT project, avg(cbo) AS ca, max(cbo) AS cx, quantile_cont(cbo::DOUBLE, 0.95) AS c95 FROM cc GROUP BY ALL), di AS (SELECT project, avg(distance) AS d FROM ms GROUP BY ALL),
h AS (SELECT r.project, greatest(0, least(100, 100 - 1.5 * greatest(coalesce(cs, 0) / greatest(n, 1) - 3, 0) - 3 * sqrt(greatest(coalesce(cp, 0) - 5, 0)) - 0.8 * sqrt(greatest(coalesce(cm, 0) - 20, 0)))) AS cx,
  greatest(0, least(100, 50 * sqrt(0.5) + 50)) AS coh,
  greatest(0, least(100, 1800 / (18 + 6 * coalesce(d, 0) + 3 * greatest(coalesce(ca, 0) - 8, 0) + 0.4 * greatest(coalesce(c95, 0) - 15, 0) + 0.8 * sqrt(greatest(coalesce(cb.cx, 0) - 30, 0))))) AS cou,
  100.0::DOUBLE AS typ, greatest(0, least(100, 100 - 2 * greatest(82 - coalesce(ma, 75), 0) - 4.5 * sqrt(greatest(55 - coalesce(mp, 55), 0)) - 1.5 * pow(greatest(5 - coalesce(mm, 5), 0), 0.4))) AS mai
  FROM r LEFT JOIN cb ON cb.project = r.project LEFT JOIN di ON di.project = r.project),
hp AS (SELECT project, round(cx, 4) AS health__complexity, round(coh, 4) AS health__cohesion, round(cou, 4) AS health__coupling, typ AS health__typing, round(mai, 4) AS health__maintainability,
  round(greatest(0, least(100, .3 * cx + .2 * coh + .2 * cou + .1 * typ + .2 * mai)), 4) AS health__overall FROM h)
"""
)
_HS = (
    _HP
    + """, dm AS (SELECT * FROM (VALUES ('complexity', 0.3, 50, 25), ('cohesion', 0.2, 50, 25), ('coupling', 0.2, 50, 25), ('typing', 0.1, 80, 50), ('maintainability', 0.2, 50, 25), ('overall', NULL, 50, 30)) t(dimension, weight, w, e)),
sc AS (SELECT project, dimension, CASE dimension WHEN 'complexity' THEN health__complexity WHEN 'cohesion' THEN health__cohesion WHEN 'coupling' THEN health__coupling WHEN 'typing' THEN health__typing
  WHEN 'maintainability' THEN health__maintainability ELSE health__overall END AS score, weight::DOUBLE AS weight, w, e FROM hp, dm),
hs AS (SELECT project, dimension, score, CASE WHEN score > w + (100 - w) * 0.6 THEN 'Excellent' WHEN score > w + (100 - w) * 0.3 THEN 'Good' WHEN score > w THEN 'Fair' WHEN score > e THEN 'Poor' ELSE 'Critical' END AS label,
  weight, round(weight * (100 - score), 4) AS loss FROM sc)
"""
)
_F = findings._F
ORACLE = {
    "health_project": _HP + "SELECT * FROM hp",
    "health_summary": _HS + "SELECT * FROM hs",
    "report_summary": _HS + "SELECT project || ' ' || rpad(dimension, 15, ' ') || ' [' || repeat('#', round(score / 10)::INT) || repeat('.', 10 - round(score / 10)::INT) || '] ' || printf('%.1f', score) || ' ' || label AS value FROM hs",
    "computed_findings": f"""WITH hn AS ({measures.ORACLE["health_namespace"]}),
l AS (SELECT 'ns:::' || project || '::' || namespace AS subject_key, unnest(['complexity', 'cohesion', 'coupling', 'typing', 'maintainability', 'overall']) AS d,
  round(unnest([health__complexity, health__cohesion, health__coupling, health__typing, health__maintainability, health__overall]), 1) AS value, unnest([50, 50, 50, 80, 50, 50])::DOUBLE AS w, unnest([25, 25, 25, 50, 25, 30])::DOUBLE AS e FROM hn)
SELECT 'computed#health.' || d AS channel, subject_key, CASE WHEN value < e THEN 'error' ELSE 'warning' END AS severity, value, CASE WHEN value < e THEN e ELSE w END AS threshold FROM l WHERE value < w""",
    "worst_namespaces": SUBJECTS
    + f""", hn AS ({measures.ORACLE["health_namespace"]}) SELECT project || '::' || namespace AS subject_key, health__overall FROM hn
WHERE (project, namespace) IN (SELECT (project, namespace) FROM sub WHERE type = 'class' AND namespace <> '') AND health__overall IS NOT NULL ORDER BY health__overall, subject_key LIMIT 20""",
    "worst_in_namespace": f"""WITH hc AS ({measures.ORACLE["health_class"]}) SELECT project || '::' || class_key AS subject_key, health__overall FROM hc
WHERE regexp_matches(regexp_extract(class_key, '^((?s:.*))\\\\[^\\\\]*$', 1), '^(?s:.*)\\\\Domain\\\\(?s:.*)$') AND health__overall IS NOT NULL ORDER BY health__overall, subject_key LIMIT 20""",
    "findings_drill_down": _F + """SELECT project, namespace, count(*) AS findings FROM f WHERE regexp_matches(namespace, '^(?s:.*)\\\\Domain\\\\(?s:.*)$') GROUP BY ALL""",
    "findings_by_file": _F
    + """SELECT file, count(*) AS findings, count(*) FILTER (WHERE severity = 'error') AS errors, sum(minutes)::BIGINT AS minutes, first(channel ORDER BY coalesce(line, 0), channel, subject_key) AS first FROM f GROUP BY file""",
    "top_issues": _F
    + """, o AS (SELECT channel, subject_key, round(abs(value - threshold), 6) AS over, count(*) OVER () AS total FROM f) SELECT channel, subject_key, over, total, total > 25 AS truncated, greatest(total - 25, 0) AS more FROM o ORDER BY over DESC, channel, subject_key LIMIT 25""",
    "identity_order": _F
    + """SELECT channel, subject_key, row_number() OVER (ORDER BY subject_key || chr(31) || channel || chr(31) || chr(31) || chr(31), file NULLS FIRST, coalesce(line, 0), value) AS position FROM f""",
    "report_graph_json": f"""WITH ex AS ({graphs.ORACLE["edge_export"]}) SELECT to_json(struct_pack("from" := "from", "to" := "to", types := types, count := count))::VARCHAR AS value FROM ex""",
}

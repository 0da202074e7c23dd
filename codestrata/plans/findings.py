"""Findings: rules, overrides, suppressions, baselines, scopes, rankings and reports."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators import policy, rank, rules
from codestrata.plans.base import SUBJECTS, rounded, subjects
from codestrata.plans.graphs import RANK_SQL, class_rank_rounds
from codestrata.plans.measures import ORACLE as MEASURES_SQL
from codestrata.plans.measures import health_class
from codestrata.sinks import formats

CCN = rules.RULES[0]
MI = replace(next(r for r in rules.RULES if r.name == "maintainability.index"), gate="true")  # the table counts no statements
CHANNELS = [(CCN.channel, "magnitude", "higher"), (MI.channel, "magnitude", "lower"), ("size.loc#size.loc", "occurrence", "higher")]
LOC = rules.Rule("size.loc", "size.loc", "loc", "callable", 60, 100, minutes=20, whole=True)


def _callables(spark: SparkSession, folder: str) -> DataFrame:
    rows = subjects(spark, folder).where("type IN ('method', 'function')")
    return rows.withColumn("subject_key", F.concat_ws("::", "project", "name"))


def _findings(spark: SparkSession, folder: str, overrides: DataFrame | None = None) -> DataFrame:
    rows = _callables(spark, folder)
    found = rules.run_rules({"callable": rows}, [CCN, MI, LOC], overrides)
    what = rows.select("subject_key", "project", "class_key", "namespace").dropDuplicates(["subject_key"])
    return found.join(what, "subject_key")


def threshold_findings(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_findings(spark, folder).select(*rules.FINDING))


def _overrides(spark: SparkSession, folder: str) -> DataFrame:
    """Inline thresholds for what sits on a round line: by name for the class (rank 1), by family for the symbol (2)."""
    rows = _callables(spark, folder).where("line % 10 = 0").select("subject_key", "line")
    low = rows.select("subject_key", F.lit("complexity").alias("selector"), F.lit(1).alias("scope_rank"), F.col("line").alias("span"), F.lit(0).alias("seq"), F.lit(3.0).alias("warning"), F.lit(5.0).alias("error"))
    high = rows.where("line % 20 = 0").select("subject_key", F.lit("complexity.cyclomatic"), F.lit(2), F.col("line"), F.lit(1), F.lit(8.0), F.lit(None).cast("double"))
    return low.union(high)


def override_findings(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_findings(spark, folder, _overrides(spark, folder)).where(F.col("channel") == CCN.channel).select(*rules.FINDING))


def debt_summary(spark: SparkSession, folder: str) -> DataFrame:
    found = _findings(spark, folder)
    worse = F.when(F.col("channel") == MI.channel, "lower").otherwise("higher")
    timed = found.withColumn("minutes", rules.overshoot_minutes(F.col("minutes"), F.col("value"), F.col("threshold"), worse))
    return rank.debt(timed)


def severity_counts(spark: SparkSession, folder: str) -> DataFrame:
    return rank.severity_counts(_findings(spark, folder))


def contributors(spark: SparkSession, folder: str) -> DataFrame:
    rows = _callables(spark, folder)
    long = rows.select("subject_key", F.expr("stack(3, 'ccn', cast(ccn as double), 'mi', mi, 'loc', cast(loc as double)) as (metric, value)"))
    return rank.contributors(long, {"ccn": "higher", "mi": "lower", "loc": "higher"}).select("metric", "subject_key", "value", "rank")


def impact_top(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 findings of most impact, by the rank of their class in its project's graph."""
    ranks = class_rank_rounds(spark, folder)
    return rank.impact(_findings(spark, folder), ranks, 50).select("channel", "subject_key", "file", "line", "severity", F.round("impact", 6).alias("impact"))


def worst_classes(spark: SparkSession, folder: str) -> DataFrame:
    scores = health_class(spark, folder).withColumn("subject_key", F.concat_ws("::", "project", "class_key"))
    return rank.worst(scores, "health__overall", 20).select("subject_key", "health__overall")


def _directives(spark: SparkSession, folder: str) -> DataFrame:
    """Ignore directives as a corpus has them: for symbols on lines that end in 7, for whole files that end in 3, and
    above lines that end in 9."""
    rows = _callables(spark, folder).where("line IS NOT NULL")
    symbol = rows.where("line % 10 = 7").select("symbol_id", F.lit("symbol").alias("kind"), "subject_key", "file", "line", F.lit("complexity").alias("selector"))
    line = rows.where("line % 10 = 9").select("symbol_id", F.lit("next-line").alias("kind"), F.lit(None).cast("string").alias("subject_key"), "file", (F.col("line") - 1).alias("line"), F.lit("*").alias("selector"))
    file = rows.where("file IS NOT NULL AND line % 100 = 3").select("symbol_id", F.lit("file").alias("kind"), F.lit(None).cast("string").alias("subject_key"), "file", "line", F.lit(MI.channel).alias("selector"))
    offset = F.when(F.col("kind") == "symbol", 0).when(F.col("kind") == "file", 1).otherwise(2)
    return symbol.unionByName(line).unionByName(file).withColumn("directive_id", F.col("symbol_id") * 3 + offset).drop("symbol_id")


def _numbered(spark: SparkSession, folder: str) -> DataFrame:
    return _findings(spark, folder).withColumn("finding_id", F.concat_ws("|", "channel", "subject_key"))


def suppression(spark: SparkSession, folder: str) -> DataFrame:
    return policy.suppressed(_numbered(spark, folder), _directives(spark, folder)).select("finding_id", "suppressed_by")


def unused_directives(spark: SparkSession, folder: str) -> DataFrame:
    return policy.unused_directives(_findings(spark, folder), _directives(spark, folder)).select("directive_id", "kind")


def _channels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CHANNELS, "channel string, shape string, worse string")


def _class_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Findings told apart by class only, so that an identity has several magnitudes."""
    return _findings(spark, folder).where("class_key IS NOT NULL").withColumn("subject_key", F.concat_ws("::", "project", "class_key"))


def _accepted(spark: SparkSession, folder: str) -> DataFrame:
    """The baseline of an earlier state: without symbols on lines that end in 1, values 10 % lower on those with 2."""
    old = _class_findings(spark, folder).where("line IS NULL OR line % 10 <> 1").withColumn("value", F.when(F.col("line") % 10 == 2, F.col("value") * 0.9).otherwise(F.col("value")))
    return policy.generate_baseline(old)


def baseline_generate(spark: SparkSession, folder: str) -> DataFrame:
    out = policy.generate_baseline(_class_findings(spark, folder))
    return out.select(F.replace("identity_key", F.lit(policy.SEPARATOR), F.lit("|")).alias("identity_key"), "channel", "magnitudes", "count")


def baseline_ceiling(spark: SparkSession, folder: str) -> DataFrame:
    """Each identity's verdict against the earlier state."""
    judged = policy.judge(_class_findings(spark, folder), _accepted(spark, folder), _channels(spark))
    return judged.select(F.replace("identity_key", F.lit(policy.SEPARATOR), F.lit("|")).alias("identity_key"), "now_count", "base_count", "verdict")


def baseline_update(spark: SparkSession, folder: str) -> DataFrame:
    base = _accepted(spark, folder)
    judged = policy.judge(_class_findings(spark, folder), base, _channels(spark))
    return policy.update_baseline(base, judged).groupBy("channel", "outcome").agg(F.count("*").alias("entries"), F.sum("count").alias("accepted"))


def projection(spark: SparkSession, folder: str) -> DataFrame:
    """Every finding once: kept, or removed by the first stage that does."""
    found = _numbered(spark, folder)
    changed = subjects(spark, folder).where("type = 'file' AND file IS NOT NULL").select(F.col("file").alias("path"), "namespace")
    out = policy.project_findings(found, _directives(spark, folder), ["src/Queue"], ["*\\Billing\\*"], changed=changed)
    return out.select("finding_id", F.coalesce("removed_by", F.lit("kept")).alias("removed_by"))


def exit_code(spark: SparkSession, folder: str) -> DataFrame:
    return policy.verdict(_findings(spark, folder))


def report_text(spark: SparkSession, folder: str) -> DataFrame:
    return formats.text_lines(_findings(spark, folder))


def report_github(spark: SparkSession, folder: str) -> DataFrame:
    return formats.github_lines(_findings(spark, folder))


def report_gitlab(spark: SparkSession, folder: str) -> DataFrame:
    return formats.gitlab(_findings(spark, folder))


def report_sarif(spark: SparkSession, folder: str) -> DataFrame:
    return formats.sarif_results(_findings(spark, folder))


def report_checkstyle(spark: SparkSession, folder: str) -> DataFrame:
    return formats.checkstyle(_findings(spark, folder))


def report_json(spark: SparkSession, folder: str) -> DataFrame:
    return formats.findings_json(_findings(spark, folder).select(*rules.FINDING))


def report_metrics(spark: SparkSession, folder: str) -> DataFrame:
    rows = _callables(spark, folder)
    long = rows.select("project", "name", F.expr("stack(3, 'ccn', cast(ccn as double), 'mi', mi, 'loc', cast(loc as double)) as (metric, value)"))
    return formats.metrics_map(long, ["project", "name"]).select("project", "name", F.to_json("metrics").alias("metrics"))


def report_dot(spark: SparkSession, folder: str) -> DataFrame:
    from codestrata.plans.graphs import edge_export

    return formats.dot_lines(edge_export(spark, folder))


def report_tree(spark: SparkSession, folder: str) -> DataFrame:
    rows = subjects(spark, folder).where("type = 'method'")
    per_class = rows.groupBy("project", "namespace", "class_key").agg(F.sum("loc").alias("loc"), F.avg("mi").alias("score"), F.count_if(F.col("ccn") >= 10).alias("findings"))
    return rounded(formats.html_tree(per_class))


_F = (
    SUBJECTS
    + """, c AS (SELECT *, project || '::' || name AS subject_key FROM sub WHERE type IN ('method', 'function')),
v AS (SELECT *, unnest(['complexity.cyclomatic#complexity.cyclomatic.callable', 'maintainability.index#maintainability.index', 'size.loc#size.loc']) AS channel,
  unnest([ccn::DOUBLE, mi, loc::DOUBLE]) AS value, unnest([10.0, 40.0, 60.0]::DOUBLE[]) AS w, unnest([20.0, 20.0, 100.0]::DOUBLE[]) AS e, unnest([1, -1, 1]) AS d, unnest([30, 60, 20]) AS minutes FROM c),
f0 AS (SELECT *, CASE WHEN d = 1 AND value >= e OR d = -1 AND value < e THEN 'error' WHEN d = 1 AND value >= w OR d = -1 AND value < w THEN 'warning' END AS severity FROM v),
f AS (SELECT *, CASE severity WHEN 'error' THEN e ELSE w END AS threshold FROM f0 WHERE severity IS NOT NULL)
"""
)
_CF = (
    _F
    + """, cf AS (SELECT project || '::' || class_key || '|' || channel || '|||' AS identity_key, channel, d, line, value FROM f WHERE class_key IS NOT NULL),
now AS (SELECT identity_key, channel, any_value(d) AS d, list_sort(list(round(value, 6))) AS m, count(*) AS n FROM cf GROUP BY ALL),
old AS (SELECT identity_key, channel, list_sort(list(round(CASE WHEN line % 10 = 2 THEN value * 0.9 ELSE value END, 6))) AS m, count(*) AS n FROM cf WHERE line IS NULL OR line % 10 <> 1 GROUP BY ALL),
j AS (SELECT coalesce(now.identity_key, old.identity_key) AS identity_key, coalesce(now.channel, old.channel) AS channel, now.d, now.m AS nm, old.m AS om, now.n AS nn, old.n AS bn FROM now FULL JOIN old ON now.identity_key = old.identity_key),
jv AS (SELECT *, CASE WHEN bn IS NULL THEN 'new' WHEN nn IS NULL THEN 'stale' WHEN channel = 'size.loc#size.loc' THEN CASE WHEN nn <= bn THEN 'within' ELSE 'breach' END
  WHEN nn <= bn AND list_bool_and(list_transform(nm, lambda x: len(list_filter(nm, lambda y: (y >= x AND d = 1) OR (y <= x AND d = -1))) <= len(list_filter(om, lambda y: (y >= x AND d = 1) OR (y <= x AND d = -1))))) THEN 'within' ELSE 'breach' END AS verdict FROM j)
"""
)
_DIR = """, l AS (SELECT *, project || '::' || name AS subject_key FROM sub WHERE type IN ('method', 'function') AND line IS NOT NULL),
dr AS (SELECT symbol_id * 3 AS directive_id, 'symbol' AS kind, subject_key AS ds, file AS df, line AS dl, 'complexity' AS selector FROM l WHERE line % 10 = 7
  UNION ALL SELECT symbol_id * 3 + 2, 'next-line', NULL, file, line - 1, '*' FROM l WHERE line % 10 = 9
  UNION ALL SELECT symbol_id * 3 + 1, 'file', NULL, file, line, 'maintainability.index#maintainability.index' FROM l WHERE file IS NOT NULL AND line % 100 = 3),
hit AS (SELECT f.channel || '|' || f.subject_key AS finding_id, directive_id FROM f JOIN dr ON kind = 'symbol' AND f.subject_key = ds AND f.channel LIKE 'complexity.%'
  UNION ALL SELECT f.channel || '|' || f.subject_key, directive_id FROM f JOIN dr ON kind = 'file' AND f.file = df AND f.channel = selector
  UNION ALL SELECT f.channel || '|' || f.subject_key, directive_id FROM f JOIN dr ON kind = 'next-line' AND f.file = df AND f.line = dl + 1),
sb AS (SELECT finding_id, min(directive_id) AS suppressed_by FROM hit GROUP BY ALL)
"""
QUERIES = {
    f.__name__: f
    for f in (
        threshold_findings, override_findings, debt_summary, severity_counts, contributors, impact_top, worst_classes, suppression, unused_directives, baseline_generate,
        baseline_ceiling, baseline_update, projection, exit_code, report_text, report_github, report_gitlab, report_sarif, report_checkstyle, report_json, report_metrics, report_dot, report_tree,
    )
}
_COLS = "channel, subject_key, file, line, severity, round(value, 9) AS value, threshold, minutes"
ORACLE = {
    "threshold_findings": _F + f"SELECT {_COLS} FROM f",
    "override_findings": _F
    + """, o AS (SELECT *, CASE WHEN line % 20 = 0 THEN 8.0 WHEN line % 10 = 0 THEN 3.0 ELSE 10.0 END::DOUBLE AS w2, CASE WHEN line % 20 = 0 THEN NULL WHEN line % 10 = 0 THEN 5.0 ELSE 20.0 END::DOUBLE AS e2 FROM v WHERE channel LIKE 'complexity%'),
o2 AS (SELECT *, CASE WHEN coalesce(value >= e2, false) THEN 'error' WHEN value >= w2 THEN 'warning' END AS severity FROM o)
SELECT channel, subject_key, file, line, severity, value, CASE severity WHEN 'error' THEN e2 ELSE w2 END AS threshold, minutes FROM o2 WHERE severity IS NOT NULL""",
    "debt_summary": _F
    + """, t AS (SELECT *, CASE d WHEN 1 THEN value / nullif(threshold, 0) ELSE threshold / nullif(value, 0) END AS ratio FROM f),
u AS (SELECT file, split_part(channel, '#', 1) AS rule, CASE WHEN ratio > 1 AND value > 0 AND isfinite(ratio) THEN greatest(1, round(minutes * greatest(1, ln(ratio))))::INT ELSE minutes END AS minutes FROM t)
SELECT 'total' AS scope, '' AS name, sum(minutes)::BIGINT AS minutes, count(*) AS findings FROM u UNION ALL SELECT 'file', file, sum(minutes), count(*) FROM u GROUP BY file UNION ALL SELECT 'rule', rule, sum(minutes), count(*) FROM u GROUP BY rule""",
    "severity_counts": _F + "SELECT count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings, count(*) FILTER (WHERE severity = 'info') AS infos FROM f",
    "contributors": SUBJECTS
    + """, l AS (SELECT project || '::' || name AS subject_key, unnest(['ccn', 'mi', 'loc']) AS metric, unnest([ccn::DOUBLE, mi, loc::DOUBLE]) AS value, unnest([-1, 1, -1]) AS d FROM sub WHERE type IN ('method', 'function')),
r AS (SELECT metric, subject_key, value, row_number() OVER (PARTITION BY metric ORDER BY value * d, subject_key)::INT AS rank FROM l WHERE value IS NOT NULL) SELECT * FROM r WHERE rank <= 10""",
    "impact_top": RANK_SQL
    + _F.replace("WITH RECURSIVE ", ", ", 1).strip()
    + """, md AS (SELECT project, quantile_cont(round(rank, 9), 0.5) AS med FROM r12 GROUP BY ALL),
i AS (SELECT channel, subject_key, file, line, severity, round(coalesce(round(rank, 9), med, 0) * CASE severity WHEN 'error' THEN 3 ELSE 1 END * minutes, 6) AS impact FROM f LEFT JOIN r12 k ON k.project = f.project AND k.class = f.class_key LEFT JOIN md ON md.project = f.project)
SELECT * FROM i ORDER BY impact DESC, file NULLS FIRST, coalesce(line, 0), channel, subject_key LIMIT 50""",
    "suppression": _F + _DIR + "SELECT f.channel || '|' || f.subject_key AS finding_id, suppressed_by FROM f LEFT JOIN sb ON sb.finding_id = f.channel || '|' || f.subject_key",
    "unused_directives": _F + _DIR + "SELECT directive_id, kind FROM dr WHERE directive_id NOT IN (SELECT directive_id FROM hit)",
    "baseline_generate": _CF + "SELECT identity_key, channel, m AS magnitudes, n AS count FROM now",
    "baseline_ceiling": _CF + "SELECT identity_key, nn AS now_count, bn AS base_count, verdict FROM jv",
    "baseline_update": _CF
    + """, u AS (SELECT channel, CASE verdict WHEN 'within' THEN 'updated' WHEN 'breach' THEN 'refused' ELSE 'untouched' END AS outcome, CASE verdict WHEN 'within' THEN nn ELSE bn END AS n FROM jv WHERE bn IS NOT NULL)
SELECT channel, outcome, count(*) AS entries, sum(n)::BIGINT AS accepted FROM u GROUP BY ALL""",
    "projection": _F
    + _DIR
    + """, ch AS (SELECT DISTINCT file FROM sub WHERE type = 'file' AND file IS NOT NULL)
SELECT f.channel || '|' || f.subject_key AS finding_id, CASE WHEN sb.suppressed_by IS NOT NULL THEN 'suppression' WHEN f.file = 'src/Queue' OR starts_with(f.file, 'src/Queue/') THEN 'path'
  WHEN f.namespace LIKE '%' || chr(92) || 'Billing' || chr(92) || '%' ESCAPE '^' THEN 'namespace' WHEN f.file IS NULL OR f.file IN (SELECT file FROM ch) THEN 'kept' ELSE 'scope' END AS removed_by
FROM f LEFT JOIN sb ON sb.finding_id = f.channel || '|' || f.subject_key""",
    "exit_code": _F + "SELECT CASE max(CASE severity WHEN 'error' THEN 2 ELSE 1 END) WHEN 2 THEN 2 ELSE 0 END AS exit_code FROM f",
    "report_text": _F + "SELECT coalesce(file, '(project)') || ':' || coalesce(line, 0) || ': ' || severity || ' [' || channel || '] ' || subject_key AS value FROM f",
    "report_github": _F + "SELECT '::' || severity || ' file=' || coalesce(file, '') || ',line=' || coalesce(line, 1) || '::' || replace(channel || ' ' || subject_key, '%', '%25') AS value FROM f",
    "report_gitlab": _F
    + """SELECT to_json(struct_pack(description := channel || ' ' || subject_key, check_name := channel, fingerprint := md5(channel || ':' || subject_key), severity := CASE severity WHEN 'error' THEN 'critical' ELSE 'major' END,
location := struct_pack(path := coalesce(file, ''), lines := struct_pack("begin" := coalesce(line, 1)))))::VARCHAR AS value FROM f""",
    "report_sarif": _F
    + """SELECT to_json(struct_pack(ruleId := channel, level := severity, message := struct_pack(text := channel || ' ' || subject_key), fingerprints := struct_pack("primary" := md5(channel || ':' || subject_key)),
locations := [struct_pack(physicalLocation := struct_pack(artifactLocation := struct_pack(uri := coalesce(file, '')), region := struct_pack(startLine := coalesce(line, 1))))]))::VARCHAR AS value FROM f""",
    "report_checkstyle": _F
    + """, x AS (SELECT coalesce(file, '(project)') AS file, coalesce(line, 1) AS line, '<error line="' || coalesce(line, 1) || '" severity="' || severity || '" message="' || replace(replace(replace(replace(subject_key, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '" source="' || channel || '"/>' AS error FROM f)
SELECT '<file name="' || replace(replace(replace(replace(file, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '">' || string_agg(error, '' ORDER BY line, error) || '</file>' AS value FROM x GROUP BY file""",
    "report_json": _F
    + """SELECT '{' || array_to_string(list_filter(['"channel":' || to_json(channel), '"file":' || to_json(file), '"line":' || line, '"minutes":' || minutes, '"severity":' || to_json(severity), '"subject_key":' || to_json(subject_key),
'"threshold":' || to_json(threshold), '"value":' || to_json(value)], lambda x: x IS NOT NULL), ',') || '}' AS value FROM f""",
    "report_metrics": SUBJECTS + "SELECT project, name, json_object('ccn', ccn::DOUBLE, 'loc', loc::DOUBLE, 'mi', mi)::VARCHAR AS metrics FROM sub WHERE type IN ('method', 'function')",
    "report_dot": """SELECT '  "' || replace(replace(src_class, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '" -> "' || replace(replace(dst_class, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '" [label="' || array_to_string(list_sort(list_distinct(list(dep_type))), ',') || '"];' AS value
FROM edges WHERE src_class IS NOT NULL AND dst_class IS NOT NULL GROUP BY project, src_class, dst_class""",
    "worst_classes": f"""WITH hc AS ({MEASURES_SQL["health_class"]}) SELECT project || '::' || class_key AS subject_key, health__overall FROM hc WHERE health__overall IS NOT NULL ORDER BY health__overall, subject_key LIMIT 20""",
    "report_tree": SUBJECTS
    + """, k AS (SELECT project, namespace, class_key, sum(loc) AS loc, avg(mi) AS score, count(*) FILTER (WHERE ccn >= 10) AS findings FROM sub WHERE type = 'method' AND namespace <> '' GROUP BY ALL),
s AS (SELECT *, unnest(range(1, len(string_split(namespace, chr(92))) + 1)) AS dp FROM k), u AS (SELECT project, array_to_string(string_split(namespace, chr(92))[1:dp], chr(92)) AS namespace, loc, score, findings FROM s)
SELECT project, namespace, sum(loc)::BIGINT AS loc, round(sum(score * loc) FILTER (WHERE score IS NOT NULL AND loc IS NOT NULL) / nullif(sum(loc) FILTER (WHERE score IS NOT NULL AND loc IS NOT NULL), 0), 9) AS score, sum(findings)::BIGINT AS findings, round(sum(findings) / nullif(sum(loc), 0), 9) AS density FROM u GROUP BY ALL""",
}

"""A whole analysis: from source files to measures, findings and an exit code, as one set of lazy tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.matching import selected
from codestrata.functions.text import is_sensitive_name
from codestrata.operators import clones, graph, policy, rules
from codestrata.plans.base import above
from codestrata.session import cut
from codestrata.sources.config import configure
from codestrata.sources.files import coverage, edges_of, php_facts, php_tokens

# fixed values: the least tokens and lines of a clone
CLONE_TOKENS, CLONE_LINES = 70, 5


@dataclass
class Run:
    """The tables of an analysis; `findings` are all that the rules say, `projected` has `removed_by` of each."""

    files: DataFrame
    facts: DataFrame
    edges: DataFrame
    callables: DataFrame
    classes: DataFrame
    namespaces: DataFrame
    findings: DataFrame
    projected: DataFrame
    diagnoses: DataFrame
    settings: Mapping[str, Any] = field(default_factory=dict)

    def coverage(self) -> DataFrame:
        return coverage(self.files, self.facts)

    def kept(self) -> DataFrame:
        return self.projected.where("removed_by IS NULL")

    def verdict(self) -> DataFrame:
        return policy.verdict(self.kept(), self.settings.get("failOn", "error"))


def _value(name: str) -> Column:
    return F.col("values")[name]


def _subjects(facts: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Wide callables, classes and namespaces, with what the rules' gates read."""
    rows = facts.where("kind = 'callable'")
    names = {"ccn": "ccn", "cognitive": "cognitive", "npath": "npath", "statements": "statements", "mi": "mi", "parameter_count": "parameters", "unreachable": "unreachable"}
    callables = rows.select(
        F.col("subject").alias("subject_key"), "file", "line", F.col("owner").alias("class_key"), F.col("extra")["end_line"].cast("int").alias("end_line"), *[_value(v).alias(k) for k, v in names.items()],
        (_value("isVoConstructor") == 1).alias("is_vo_constructor"), F.lower("file").rlike("(^|/)tests?/|test[.]php$").alias("is_test"),
    )
    per_class = callables.groupBy("file", "class_key").agg(F.max("ccn").alias("ccn_max"), F.max("cognitive").alias("cognitive_max"), F.max("npath").alias("npath_max"))
    names = {"lcom": "lcom", "tcc": "tcc", "wmc": "wmc", "woc": "woc", "members": "members", "method_count": "methodCount", "property_count": "propertyCount", "class_loc": "classLoc", "constructor_parameters": "constructorParameters", "unused_private": "unusedPrivate"}
    cover = [
        F.when(_value(f"typeCoverage.{w}.total") > 0, 100 * _value(f"typeCoverage.{w}.typed") / _value(f"typeCoverage.{w}.total")).alias(f"type_coverage_{w}") for w in ("param", "return", "property")
    ]
    own = facts.where("kind = 'class'").select(
        F.col("subject").alias("subject_key"), F.col("subject").alias("class"), "file", "line", F.col("extra")["namespace"].alias("namespace"), F.col("extra")["kind"].alias("kind"), *[_value(v).alias(k) for k, v in names.items()], *cover,
        *[(_value(v) == 1).alias(k) for k, v in (("is_readonly", "isReadonly"), ("is_promoted_only", "isPromotedOnly"), ("is_exception", "isException"))],
    )
    known = own.select(F.lit("").alias("project"), "class").distinct()
    coupled = graph.class_coupling(graph.without_builtins(edges)).drop("project")
    depth, kids = (op(edges, known).drop("project") for op in (graph.inheritance_depth, graph.children))
    classes = own
    for more in (coupled, depth, kids):
        classes = classes.join(more, "class", "left")
    classes = classes.join(per_class.withColumnRenamed("class_key", "class"), ["file", "class"], "left")
    counts = own.groupBy("namespace").agg(F.count("*").alias("class_count"), F.min("file").alias("file"))
    a = graph.abstractness(own.select(F.lit("").alias("project"), "namespace", "kind")).drop("project")
    spaces = counts.join(graph.namespace_coupling(edges).drop("project"), "namespace", "left").join(a, "namespace", "left")
    below = counts.select(F.explode_outer(F.slice(_above(F.col("namespace")), 1, 1000)).alias("namespace")).where("namespace IS NOT NULL").distinct().withColumn("has_below", F.lit(True))
    spaces = spaces.join(below, "namespace", "left").select(
        F.concat(F.lit("ns:"), "namespace").alias("subject_key"), "file", F.lit(None).cast("int").alias("line"), "namespace", "class_count", "ca", "cbo", "instability",
        graph.distance(F.col("abstractness"), F.coalesce("instability", F.lit(0.0))).alias("distance"), F.col("has_below").isNull().alias("is_leaf"),
    )
    return callables, classes, spaces


def _above(namespace: Column) -> Column:
    from codestrata.operators.rollup import ancestors

    return F.slice(ancestors(namespace), F.lit(1), F.greatest(F.size(ancestors(namespace)) - 1, F.lit(0)))


def _control(facts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ignore directives, threshold overrides, all directives), bound to the declarations they belong to."""
    rows = facts.where("kind = 'directive'").select(
        F.xxhash64("file", "line", "subject", F.to_json("extra")).alias("directive_id"), F.col("subject").alias("kind"), "file", "line", F.col("extra")["selector"].alias("selector"),
        *[F.col("extra")[c].try_cast("double").alias(c) for c in ("warning", "error")], F.coalesce(F.col("extra")["malformed"] == "true", F.lit(False)).alias("malformed"),
    )
    ends = F.when(F.col("kind") == "class", F.col("line") + _value("classLoc").cast("int") - 1).otherwise(F.col("extra")["end_line"].cast("int"))
    scopes = facts.where("kind IN ('class', 'callable')").select("file", F.col("line").alias("start"), ends.alias("end"), F.col("subject").alias("subject_key"), F.when(F.col("kind") == "class", 1).otherwise(2).alias("scope_rank"))
    bound = cut(policy.bind_directives(rows, scopes))
    overrides = bound.where("kind = 'threshold' AND NOT malformed AND subject_key IS NOT NULL").select("subject_key", "selector", "scope_rank", F.lit(0).alias("span"), F.col("line").alias("seq"), "warning", "error")
    return bound.where("kind <> 'threshold'"), overrides, bound


def _occurrences(facts: DataFrame) -> DataFrame:
    found = facts.where("kind = 'entry'").select("file", F.col("subject").alias("kind"), "line", F.col("extra")["detail"].alias("extra"))
    names = facts.where("kind = 'parameter' AND extra['sensitive'] = 'false'").where(is_sensitive_name(F.col("subject")))
    return found.unionByName(names.select("file", F.lit("sensitive_parameter").alias("kind"), "line", F.col("subject").alias("extra")))


def catalogue() -> list[tuple[str, str, str, bool]]:
    """Every declared channel: name, shape, which way is worse, and whether its rule only warns."""
    out = [(r.channel, "magnitude", r.worse, r.error is None) for r in rules.RULES]
    out += [(f"{n}#{n}", "occurrence", "higher", False) for n, _, _ in rules.ENTRY_RULES.values()]
    out += [(f"design.{n}#design.{n}", "magnitude", w, False) for n, w in (("god-class", "higher"), ("data-class", "lower"))]
    return list(dict.fromkeys([*out, ("coupling.class-rank#coupling.class-rank", "occurrence", "higher", False)]))


def analyse(
    files: DataFrame, options: Mapping[str, Any] | None = None, only: Sequence[str] = (), disabled: Sequence[str] = (), exclude_paths: Sequence[str] = (), exclude_namespaces: Sequence[str] = (),
    baseline: DataFrame | None = None, changed: DataFrame | None = None, settings: Mapping[str, Any] | None = None,
) -> Run:
    """Everything about `files` (`file`, `text`, `is_generated`), one project.

    `options`: rule name or code -> true, false or thresholds. `only` and `disabled` choose channels. `baseline`, as
    `sources.baseline` reads it, and `changed` (`path`, `namespace`) take findings out of the projection. Facts are
    written once; every measure and rule starts from them.
    """
    spark = files.sparkSession
    facts = cut(php_facts(files.where("NOT is_generated")))
    edges = edges_of(facts)
    callables, classes, namespaces = map(cut, _subjects(facts, edges))  # several rules and measures start from each
    ignores, overrides, directives = _control(facts)
    chosen = configure(options or {})
    tokens = cut(php_tokens(files.where("NOT is_generated")))
    pairs = clones.verified(clones.clone_pairs(tokens.select("file", "tokens"), CLONE_TOKENS), tokens).where(F.col("lines") >= CLONE_LINES)
    project = cut(pairs.select(F.lit("project:").alias("subject_key"), F.col("a_file").alias("file"), F.lit(None).cast("int").alias("line"), F.col("lines").cast("double").alias("duplicate_lines")))
    cycles = graph.strongly_connected(graph.distinct_edges(edges).select("src_class", "dst_class"), "src_class", "dst_class").groupBy("component").agg(F.count("*").cast("double").alias("cycle_size"))
    circles = cycles.select(F.concat(F.lit("cycle:"), "component").alias("subject_key"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"), "cycle_size")
    parts = [rules.run_rules({"callable": callables, "class": classes, "namespace": namespaces}, chosen, overrides)]
    parts += [rules.run_rules({"project": rows}, [r for r in chosen if r.metric in rows.columns]) for rows in (project, circles)]
    occurred = rules.entry_findings(_occurrences(facts))
    columns = rules.FINDING
    special = [
        (rules.god_class(classes.where("kind IN ('class', 'abstract')")), "design.god-class", "matched", 120), (rules.data_class(classes.where("kind = 'class'")), "design.data-class", "woc", 30),
        (rules.rank_findings(graph.class_rank(edges, classes.select(F.lit("").alias("project"), "class"))).join(classes.select("class", "file", "line"), "class").withColumn("subject_key", F.col("class")), "coupling.class-rank", "rank", 30),
    ]
    parts += [
        rows.select(F.lit(f"{name}#{name}").alias("channel"), "subject_key", "file", "line", "severity", F.col(value).cast("double").alias("value"), F.lit(None).cast("double").alias("threshold"), F.lit(minutes).alias("minutes"))
        for rows, name, value, minutes in special
    ]
    found = reduce(DataFrame.unionByName, [p.select(*columns) for p in parts]).withColumn("occ_key", F.lit(None).cast("string")).unionByName(occurred)
    found = cut(found.where(selected(F.col("channel"), only, disabled)).withColumn("finding_id", F.monotonically_increasing_id()))
    own = F.when(F.col("subject_key").startswith("ns:"), F.substring("subject_key", 4, 100_000)).when(~F.col("subject_key").rlike("^(file|project|cycle):"), above(F.substring_index("subject_key", "::", 1)))
    found = found.withColumn("namespace", own)
    channels = spark.createDataFrame(catalogue(), "channel string, shape string, worse string, warning_only boolean")
    judged = policy.judge(found, baseline, channels) if baseline is not None else None
    projected = policy.project_findings(found, ignores, exclude_paths, exclude_namespaces, judged=judged, changed=changed)
    unused = policy.unused_directives(found, ignores).select("directive_id")
    return Run(files, facts, edges, callables, classes, namespaces, found, projected, policy.diagnose(directives, channels, unused), settings or {})

"""Threshold rules: from measured subjects to findings, with per-subject overrides and remediation time."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Rule:
    """One channel of a rule. `worse` is 'higher' or 'lower'; `gate` a SQL condition on the subject; `whole` truncates
    the value before it is compared."""

    name: str
    code: str
    metric: str
    level: str
    warning: float | None
    error: float | None
    worse: str = "higher"
    minutes: int = 15
    gate: str = "true"
    whole: bool = False
    enabled: bool = True

    @property
    def needs(self) -> list[str]:
        """The columns that the gate reads."""
        return sorted(set(re.findall(r"[a-z_]+", self.gate)) - {"true", "false", "coalesce"})

    @property
    def channel(self) -> str:
        return f"{self.name}#{self.code}"


# fixed values: default thresholds and minutes of each rule
RULES: tuple[Rule, ...] = (
    Rule("complexity.cyclomatic", "complexity.cyclomatic.callable", "ccn", "callable", 10, 20, minutes=30, whole=True),
    Rule("complexity.cyclomatic", "complexity.cyclomatic.class", "ccn_max", "class", 30, 50, minutes=30, whole=True),
    Rule("complexity.cognitive", "complexity.cognitive.callable", "cognitive", "callable", 15, 30, minutes=30, whole=True),
    Rule("complexity.cognitive", "complexity.cognitive.class", "cognitive_max", "class", 30, 50, minutes=30, whole=True),
    Rule("complexity.npath", "complexity.npath.callable", "npath", "callable", 200, 1000, minutes=30, whole=True),
    Rule("complexity.npath", "complexity.npath.class", "npath_max", "class", 500, 1000, minutes=30, whole=True, enabled=False),
    Rule("complexity.wmc", "complexity.wmc", "wmc", "class", 50, 80, minutes=30, whole=True),
    Rule("maintainability.index", "maintainability.index", "mi", "callable", 40, 20, worse="lower", minutes=60, gate="statements >= 10 AND NOT coalesce(is_test, false)"),
    Rule("cohesion.lcom", "cohesion.lcom", "lcom", "class", 3, 5, minutes=45, whole=True, gate="NOT coalesce(is_readonly, false) AND method_count >= 3"),
    Rule("coupling.cbo", "coupling.cbo.class", "cbo", "class", 14, 20, minutes=45, whole=True),
    Rule("coupling.cbo", "coupling.cbo.namespace", "cbo", "namespace", 14, 20, minutes=45, whole=True, gate="class_count >= 3"),
    Rule("coupling.instability", "coupling.instability.class", "instability", "class", 0.8, 0.95, minutes=30, gate="ca >= 1"),
    Rule("coupling.instability", "coupling.instability.namespace", "instability", "namespace", 0.8, 0.95, minutes=30, gate="ca >= 1 AND class_count >= 3"),
    Rule("coupling.distance", "coupling.distance", "distance", "namespace", 0.3, 0.5, minutes=30, gate="class_count >= 3"),
    Rule("design.inheritance", "design.inheritance", "dit", "class", 4, 6, minutes=30, whole=True),
    Rule("design.noc", "design.noc", "noc", "class", 10, 15, minutes=20, whole=True),
    Rule("design.type-coverage", "design.type-coverage.param", "type_coverage_param", "class", 80, 50, worse="lower", minutes=15),
    Rule("design.type-coverage", "design.type-coverage.return", "type_coverage_return", "class", 80, 50, worse="lower", minutes=15),
    Rule("design.type-coverage", "design.type-coverage.property", "type_coverage_property", "class", 80, 50, worse="lower", minutes=15),
    Rule("size.method-count", "size.method-count", "method_count", "class", 20, 30, minutes=20, whole=True),
    Rule("size.class-count", "size.class-count", "class_count", "namespace", 15, 25, minutes=30, whole=True, gate="is_leaf"),
    Rule("size.property-count", "size.property-count", "property_count", "class", 15, 20, minutes=15, whole=True, gate="NOT coalesce(is_readonly, false) AND NOT coalesce(is_promoted_only, false)"),
    Rule("code-smell.long-parameter-list", "code-smell.long-parameter-list", "parameter_count", "callable", 4, 6, minutes=20, whole=True, gate="NOT coalesce(is_vo_constructor, false)"),
    Rule("code-smell.long-parameter-list", "code-smell.long-parameter-list.vo", "parameter_count", "callable", 8, 12, minutes=20, whole=True, gate="coalesce(is_vo_constructor, false)"),
    Rule("code-smell.constructor-overinjection", "code-smell.constructor-overinjection", "constructor_parameters", "class", 8, 12, minutes=60, whole=True),
    Rule("code-smell.unreachable-code", "code-smell.unreachable-code", "unreachable", "callable", 1, 2, minutes=10, whole=True),
    Rule("code-smell.unused-private", "code-smell.unused-private", "unused_private", "class", 1, None, minutes=15, whole=True),
    Rule("duplication.code-duplication", "duplication.code-duplication", "duplicate_lines", "project", 5, 50, minutes=15, whole=True),
    Rule("architecture.circular-dependency", "architecture.circular-dependency", "cycle_size", "project", 2, None, minutes=120, whole=True),
)
# fixed values: entries of files that are findings: kind -> (rule, severity, minutes)
ENTRY_RULES: dict[str, tuple[str, str, int]] = {
    "boolean_argument": ("code-smell.boolean-argument", "warning", 10),
    "count_in_loop": ("code-smell.count-in-loop", "warning", 10),
    "debug_code": ("code-smell.debug-code", "error", 5),
    "empty_catch": ("code-smell.empty-catch", "error", 10),
    "error_suppression": ("code-smell.error-suppression", "warning", 10),
    "eval": ("code-smell.eval", "error", 15),
    "exit": ("code-smell.exit", "warning", 10),
    "goto": ("code-smell.goto", "error", 15),
    "superglobals": ("code-smell.superglobals", "warning", 15),
    "identical_subexpression": ("code-smell.identical-subexpression", "warning", 15),
    "sql_injection": ("security.sql-injection", "error", 60),
    "xss": ("security.xss", "error", 45),
    "command_injection": ("security.command-injection", "error", 60),
    "sensitive_parameter": ("security.sensitive-parameter", "warning", 10),
}

FINDING = ["channel", "subject_key", "file", "line", "severity", "value", "threshold", "minutes"]


def severity(value: Column, warning: Column, error: Column, worse: str) -> Column:
    """'error', 'warning' or null. A null threshold is never reached; higher is `>=`, lower is `<`."""
    beyond = (lambda t: value >= t) if worse == "higher" else (lambda t: value < t)
    return F.when(F.coalesce(beyond(error), F.lit(False)), "error").when(F.coalesce(beyond(warning), F.lit(False)), "warning")


def threshold_findings(subjects: DataFrame, rules: Rule | Sequence[Rule], overrides: DataFrame | None = None) -> DataFrame:
    """Findings of rules over wide `subjects` (`subject_key`, `file`, `line`, the metrics, what the gates need), in one pass.

    A subject without the metric, with NaN, or outside the gate has none. `overrides` (`subject_key`, `selector`,
    `scope_rank`, `span`, `seq`, `warning`, `error`) replace thresholds for a subject: of several the highest rank wins,
    then the smallest span, then the first. Both thresholds are replaced; a null one is then never reached.
    """
    rules = [rules] if isinstance(rules, Rule) else list(rules)
    each = []
    for rule in rules:
        value = F.col(rule.metric).cast("double")
        value = F.when(F.expr(rule.gate) & ~F.isnan(value), value.cast("long").cast("double") if rule.whole else value)
        limits = (F.lit(t).cast("double").alias(n) for n, t in (("warning", rule.warning), ("error", rule.error)))
        each.append(F.struct(F.lit(rule.name).alias("name"), F.lit(rule.channel).alias("channel"), value.alias("value"), *limits, F.lit(rule.worse).alias("worse"), F.lit(rule.minutes).alias("minutes")))
    rows = subjects.select("subject_key", "file", "line", F.explode(F.array(*each)).alias("r")).where("r.value IS NOT NULL").select("subject_key", "file", "line", "r.*")
    if overrides is not None:
        names = F.array(*[F.lit(n) for n in sorted({r.name for r in rules})])
        mine = overrides.withColumn("_n", F.explode(names)).where((F.col("_n") == F.col("selector")) | F.startswith(F.col("_n"), F.concat("selector", F.lit("."))) | (F.col("selector") == "*"))
        first = Window.partitionBy("subject_key", "_n").orderBy(F.desc("scope_rank"), "span", "seq")
        best = mine.withColumn("_r", F.row_number().over(first)).where("_r = 1").select(F.col("subject_key").alias("_s"), "_n", F.col("warning").alias("_w"), F.col("error").alias("_e"), F.lit(True).alias("_o"))
        rows = rows.join(best, (F.col("subject_key") == F.col("_s")) & (F.col("name") == F.col("_n")), "left")
        rows = rows.withColumns({"warning": F.when(F.col("_o"), F.col("_w")).otherwise(F.col("warning")), "error": F.when(F.col("_o"), F.col("_e")).otherwise(F.col("error"))})
    up, down = (severity(F.col("value"), F.col("warning"), F.col("error"), w) for w in ("higher", "lower"))
    out = rows.withColumn("severity", F.when(F.col("worse") == "higher", up).otherwise(down)).where("severity IS NOT NULL")
    return out.select("channel", "subject_key", "file", "line", "severity", "value", F.when(F.col("severity") == "error", F.col("error")).otherwise(F.col("warning")).alias("threshold"), "minutes")


def run_rules(subjects: dict[str, DataFrame], rules: Iterable[Rule] = RULES, overrides: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """All findings of the enabled rules whose level is given and whose metric the level's subjects have.

    A flag (`is_...`) that a gate reads and the subjects lack is unknown; any other column that is missing leaves the rule
    out, or is an error if `strict`. `unrun` tells which rules that concerns. Each level is read once for all its rules.
    """
    rules = list(rules)
    parts = []
    for level, rows in subjects.items():
        mine = [r for r in rules if r.enabled and r.level == level]
        lacking = unrun({level: rows}, mine)
        if lacking and strict:
            raise ValueError(f"columns that rules need: {lacking}")
        mine = [r for r in mine if r.channel not in lacking]
        for flag in sorted({c for r in mine for c in r.needs if c.startswith("is_")} - set(rows.columns)):
            rows = rows.withColumn(flag, F.lit(None).cast("boolean"))
        if mine:
            parts.append(threshold_findings(rows, mine, overrides))
    return reduce(DataFrame.unionByName, parts)


def unrun(subjects: dict[str, DataFrame], rules: Iterable[Rule] = RULES) -> dict[str, list[str]]:
    """Per channel of an enabled rule whose level is given: the columns that it lacks, if any."""
    out = {}
    for rule in rules:
        if rule.enabled and rule.level in subjects:
            have = set(subjects[rule.level].columns)
            lacking = sorted({rule.metric, *(c for c in rule.needs if not c.startswith("is_"))} - have)
            if lacking:
                out[rule.channel] = lacking
    return out


def god_class(subjects: DataFrame) -> DataFrame:
    """Classes of at least 3 methods, not read-only, that match 3 or more of: wmc >= 47, lcom >= 3 (not if tcc >= 0.5),
    tcc < 0.33, loc >= 300. `matched` and `evaluable` criteria; all evaluable ones matched is an error, else a warning."""
    tests = [
        ("wmc", F.col("wmc") >= 47), ("lcom", (F.col("lcom") >= 3) & ~F.coalesce(F.col("tcc") >= 0.5, F.lit(False))),
        ("tcc", F.col("tcc") < 0.33), ("loc", F.col("class_loc") >= 300),
    ]
    known = reduce(lambda a, b: a + b, [F.col(c if c != "loc" else "class_loc").isNotNull().cast("int") for c, _ in tests])
    hit = reduce(lambda a, b: a + b, [F.coalesce(t, F.lit(False)).cast("int") for _, t in tests])
    rows = subjects.where("method_count >= 3 AND NOT coalesce(is_readonly, false)").select("*", hit.alias("matched"), known.alias("evaluable"))
    return rows.where("matched >= 3").withColumn("severity", F.when(F.col("matched") == F.col("evaluable"), "error").otherwise("warning"))


def data_class(subjects: DataFrame, most_woc: float = 33, most_wmc: float = 10, least_members: int = 3) -> DataFrame:
    """Classes that hold data rather than do anything: woc and wmc low, enough members, neither read-only, nor an
    exception, nor made of promoted properties only; a warning each."""
    small = (F.col("woc") <= most_woc) & (F.col("wmc") <= most_wmc) & (F.col("members") >= least_members)
    spared = [F.coalesce(F.col(c), F.lit(False)) for c in ("is_readonly", "is_exception", "is_promoted_only")]
    return subjects.where(small & ~(spared[0] | spared[1] | spared[2])).withColumn("severity", F.lit("warning"))


def rank_findings(ranks: DataFrame, warning: float = 0.02, error: float = 0.05) -> DataFrame:
    """Classes whose rank in their project of n classes reaches the thresholds divided by sqrt(n / 100)."""
    n = ranks.groupBy("project").agg(F.count("*").alias("n"))
    scaled = ranks.join(n.withColumnRenamed("project", "np"), F.col("project").eqNullSafe(F.col("np"))).drop("np").withColumn("factor", F.sqrt(F.col("n") / 100.0))
    level = severity(F.col("rank"), F.try_divide(F.lit(warning), "factor"), F.try_divide(F.lit(error), "factor"), "higher")
    return scaled.withColumn("severity", level).where("severity IS NOT NULL").drop("factor")


def entry_findings(entries: DataFrame, kinds: Sequence[str] = tuple(ENTRY_RULES), allowed: Mapping[str, Sequence[str]] = {}) -> DataFrame:  # noqa: B006
    """Findings from entries (`file`, `line`, `kind`, `extra`) of some kinds, without those whose extra is `allowed` for
    their kind. Entries of unknown kinds give none; repeated entries are findings of their own."""
    skipped = F.lit(False)
    for kind, extras in allowed.items():
        skipped = skipped | ((F.col("kind") == kind) & F.coalesce(F.col("extra").isin(*extras), F.lit(False)))
    table = F.create_map(*[x for k in kinds for x in (F.lit(k), F.struct(F.lit(ENTRY_RULES[k][0]).alias("rule"), F.lit(ENTRY_RULES[k][1]).alias("level"), F.lit(ENTRY_RULES[k][2]).alias("minutes")))])
    rows = entries.where(F.col("kind").isin(*kinds) & ~skipped).withColumn("of", table[F.col("kind")])
    none = F.lit(None).cast("double")
    return rows.select(
        F.concat_ws("#", "of.rule", "of.rule").alias("channel"), F.concat(F.lit("file:"), "file").alias("subject_key"), "file", "line", F.col("of.level").alias("severity"),
        none.alias("value"), none.alias("threshold"), "of.minutes", F.col("extra").alias("occ_key"),
    )


def computed_findings(subjects: DataFrame, formulas: Mapping[str, tuple[float | None, float | None, bool]]) -> DataFrame:
    """Findings of computed metrics: `formulas` is name -> (warning, error, inverted); inverted ones are bad below their
    thresholds, others above them (a value at a threshold is none). Values are compared after rounding to one digit."""
    each = []
    for name, (warning, error, inverted) in formulas.items():
        value = F.round(F.col(name.replace(".", "__")).cast("double"), 1)
        each.append(F.struct(F.lit(f"computed#{name}").alias("channel"), value.alias("value"), F.lit(warning).cast("double").alias("w"), F.lit(error).cast("double").alias("e"), F.lit(inverted).alias("inverted")))
    rows = subjects.select("subject_key", "file", "line", F.explode(F.array(*each)).alias("c"))  # one pass for all metrics
    beyond = lambda t: F.coalesce(F.when(F.col("c.inverted"), F.col("c.value") < t).otherwise(F.col("c.value") > t), F.lit(False))
    level = F.when(beyond(F.col("c.e")), "error").when(beyond(F.col("c.w")), "warning")
    found = rows.withColumn("severity", level).where("severity IS NOT NULL")
    return found.select("c.channel", "subject_key", "file", "line", "severity", "c.value", F.when(F.col("severity") == "error", F.col("c.e")).otherwise(F.col("c.w")).alias("threshold"), F.lit(15).alias("minutes"))


def overshoot_minutes(base: Column, value: Column, threshold: Column, worse: Column) -> Column:
    """Remediation time: `base`, or for a usable ratio of value to threshold above 1 (the inverse if lower is worse)
    base * max(1, ln ratio), rounded, at least 1."""
    ratio = F.when(worse == "lower", F.try_divide(threshold, value)).otherwise(F.try_divide(value, threshold))
    usable = ratio.isNotNull() & ~F.isnan(ratio) & (ratio > 1) & (ratio < float("inf")) & (value > 0) & (threshold > 0)
    return F.when(usable, F.greatest(F.lit(1), F.round(base * F.greatest(F.lit(1.0), F.ln(ratio))).cast("int"))).otherwise(base.cast("int"))

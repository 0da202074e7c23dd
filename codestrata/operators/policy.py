"""Which findings count: suppression, exclusion, change scope, and baselines of accepted debt."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.matching import namespace_matches, path_matches

#: A catalogue of channels is sent to every task; it has no more rows than this.
MOST_CHANNELS = 10_000
SEPARATOR = "\x1f"  # fixed value: between the parts of an identity


def selects(selector: Column, channel: Column) -> Column:
    """A directive's selector: '*', a rule#code pair, or a name that is the channel's rule or code or above it."""
    rule, code = F.substring_index(channel, "#", 1), F.substring_index(channel, "#", -1)

    def above(name: Column) -> Column:
        return (name == selector) | name.startswith(F.concat(selector, F.lit(".")))

    return (selector == "*") | (channel == selector) | above(rule) | above(code)


def suppressed(findings: DataFrame, directives: DataFrame) -> DataFrame:
    """`findings` (with a unique `finding_id`) with `suppressed_by`, the smallest id of a directive that covers it.

    `directives`: `directive_id`, `kind` (symbol, file, next-line), `subject_key`, `file`, `line`, `selector`. A symbol
    directive covers its subject, a file directive its file, a next-line one the line below it. Each kind is an
    equi-join on subject or file, so a file's directives only meet the file's findings.
    """
    d = directives.select("directive_id", "kind", F.col("subject_key").alias("ds"), F.col("file").alias("df"), F.col("line").alias("dl"), "selector")
    f = findings.select("finding_id", "channel", "subject_key", "file", "line")
    chosen = selects(F.col("selector"), F.col("channel"))
    hits = [
        f.join(d.where("kind = 'symbol'"), (F.col("subject_key") == F.col("ds")) & chosen),
        f.join(d.where("kind = 'file'"), (F.col("file") == F.col("df")) & chosen),
        f.join(d.where("kind = 'next-line'"), (F.col("file") == F.col("df")) & (F.col("line") == F.col("dl") + 1) & chosen),
    ]
    by = hits[0].select("finding_id", "directive_id")
    for h in hits[1:]:
        by = by.unionByName(h.select("finding_id", "directive_id"))
    return findings.join(by.groupBy("finding_id").agg(F.min("directive_id").alias("suppressed_by")), "finding_id", "left")


def unused_directives(findings: DataFrame, directives: DataFrame) -> DataFrame:
    """Directives that cover no finding at all."""
    chosen = selects(F.col("selector"), F.col("channel"))
    f = findings.select("channel", F.col("subject_key").alias("fs"), F.col("file").alias("ff"), F.col("line").alias("fl")).distinct()
    symbol = directives.where("kind = 'symbol'").join(f, (F.col("subject_key") == F.col("fs")) & chosen, "left_anti")
    file = directives.where("kind = 'file'").join(f, (F.col("file") == F.col("ff")) & chosen, "left_anti")
    line = directives.where("kind = 'next-line'").join(f, (F.col("file") == F.col("ff")) & (F.col("fl") == F.col("line") + 1) & chosen, "left_anti")
    return symbol.unionByName(file).unionByName(line)


def bind_directives(directives: DataFrame, scopes: DataFrame) -> DataFrame:
    """`directives` (`directive_id`, `file`, `line`) with the `subject_key` and `scope_rank` of the declaration they
    belong to: the narrowest of `scopes` (`file`, `start`, `end`, `subject_key`, `scope_rank`) around the line, or, for
    a comment above a declaration, the one that starts on the next line. Of several the higher rank, then the smaller
    span, then the key decides. Unbound ones keep nulls. The join is by file, so a file only meets itself."""
    d = directives.drop("subject_key", "scope_rank")
    s = scopes.select(F.col("file").alias("sf"), "start", "end", "subject_key", "scope_rank")
    inside = (F.col("line") >= F.col("start") - 1) & (F.col("line") <= F.col("end"))
    hits = d.select("directive_id", "file", "line").join(s, (F.col("file") == F.col("sf")) & inside)
    best = F.min_by(F.struct("subject_key", "scope_rank"), F.struct(-F.col("scope_rank"), F.col("end") - F.col("start"), F.col("subject_key"))).alias("b")
    return d.join(hits.groupBy("directive_id").agg(best), "directive_id", "left").select(*d.columns, "b.subject_key", "b.scope_rank")


def in_change_scope(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """`findings` with `in_scope`: their file is among the `changed` paths, or their namespace is one of a changed file's
    or above one, or they are about the project (no file). `changed`: `path`, `namespace`."""
    from codestrata.operators.rollup import ancestors

    files = changed.select(F.col("path").alias("cp")).distinct()
    spaces = changed.select(F.explode(ancestors(F.col("namespace"))).alias("cn")).distinct()
    rows = findings.join(files, F.col("file") == F.col("cp"), "left").join(spaces, (F.col("namespace") == F.col("cn")) & F.col("subject_key").startswith("ns:"), "left")
    return rows.withColumn("in_scope", F.col("cp").isNotNull() | F.col("cn").isNotNull() | F.col("file").isNull() & ~F.col("subject_key").startswith("ns:")).drop("cp", "cn")


def identity(findings: DataFrame) -> Column:
    """What makes two findings the same debt: subject, channel, occurrence and edge."""
    none = F.lit("")
    have = set(findings.columns)
    parts = ["subject_key", "channel", *[F.coalesce(F.col(c), none) if c in have else none for c in ("occ_key", "dep_target", "dep_type")]]
    return F.concat_ws(SEPARATOR, *parts)


def magnitude(value: Column) -> Column:
    """Six decimals, no negative zero; null for what isn't finite."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), F.round(value, 6) + F.lit(0.0))


def generate_baseline(findings: DataFrame) -> DataFrame:
    """Accepted debt: per identity the sorted `magnitudes` and the `count`. Findings that can't be accepted (a null
    channel or subject, a value that isn't finite) are left out; `rejected_findings` has them."""
    ok = findings.where(_acceptable())
    mags = F.array_sort(F.collect_list(magnitude(F.col("value"))))
    return ok.withColumn("identity_key", identity(findings)).groupBy("identity_key", "channel").agg(mags.alias("magnitudes"), F.count("*").alias("count"))


def _acceptable() -> Column:
    value = F.col("value")
    return F.col("channel").isNotNull() & F.col("subject_key").isNotNull() & (value.isNull() | (~F.isnan(value) & (F.abs(value) != float("inf"))))


def rejected_findings(findings: DataFrame) -> DataFrame:
    value = F.col("value")
    why = F.when(F.col("channel").isNull(), "undeclared").when(F.col("subject_key").isNull(), "no subject").otherwise("not finite")
    return findings.where(~F.coalesce(_acceptable(), F.lit(False))).withColumn("reason", why)


def within(current: Column, stored: Column, worse: Column) -> Column:
    """Multiset dominance: for each current level at most as many current values at least as bad as stored ones. Sorted
    from worst to best that is: not more values, and each no worse than the stored one at its place."""

    def ordered(a: Column) -> Column:
        return F.when(worse == "lower", F.array_sort(a)).otherwise(F.reverse(F.array_sort(a)))

    pairs = F.arrays_zip(ordered(current).alias("c"), ordered(stored).alias("s"))
    fits = F.forall(pairs, lambda p: p["c"].isNull() | F.coalesce(F.when(worse == "lower", p["c"] >= p["s"]).otherwise(p["c"] <= p["s"]), F.lit(False)))
    return (F.size(current) <= F.size(stored)) & fits


def judge(findings: DataFrame, baseline: DataFrame, channels: DataFrame) -> DataFrame:
    """Each identity of findings or baseline with `verdict`: new, within, breach or stale.

    `channels`: `channel`, `shape` (magnitude or occurrence), `worse`. Occurrences compare counts, magnitudes by
    dominance. `channels` is a catalogue; unknown channels count as occurrences.
    """
    now = generate_baseline(findings).select("identity_key", "channel", F.col("magnitudes").alias("now_magnitudes"), F.col("count").alias("now_count"))
    then = baseline.select("identity_key", F.col("channel").alias("base_channel"), F.col("magnitudes").alias("base_magnitudes"), F.col("count").alias("base_count"))
    both = now.join(then, "identity_key", "full").withColumn("channel", F.coalesce("channel", "base_channel")).drop("base_channel")
    both = both.join(channels.select("channel", "shape", "worse"), "channel", "left")
    fits = F.when(F.col("shape") == "magnitude", within(F.col("now_magnitudes"), F.col("base_magnitudes"), F.col("worse"))).otherwise(F.col("now_count") <= F.col("base_count"))
    verdict = F.when(F.col("base_count").isNull(), "new").when(F.col("now_count").isNull(), "stale").when(fits, "within").otherwise("breach")
    return both.select("identity_key", "channel", "now_magnitudes", "base_magnitudes", "now_count", "base_count", verdict.alias("verdict"))


def apply_baseline(findings: DataFrame, judged: DataFrame) -> DataFrame:
    """`findings` with `verdict`; a group that breaches its baseline is an error as a whole, with `accepted` levels."""
    keyed = findings.withColumn("identity_key", identity(findings))
    rows = keyed.join(judged.select("identity_key", "verdict", F.col("base_magnitudes").alias("accepted")), "identity_key", "left")
    return rows.withColumn("severity", F.when(F.col("verdict") == "breach", "error").otherwise(F.col("severity")))


def update_baseline(baseline: DataFrame, judged: DataFrame) -> DataFrame:
    """Never adds an identity; one that isn't measured stays; a measured one is replaced if it is within, else refused."""
    seen = judged.select("identity_key", "now_magnitudes", "now_count", "verdict")
    rows = baseline.join(seen, "identity_key", "left")
    take = F.col("verdict").eqNullSafe("within")
    outcome = F.when(take, "updated").when(F.col("verdict").eqNullSafe("breach"), "refused").otherwise("untouched")
    return rows.select("identity_key", "channel", F.when(take, F.col("now_magnitudes")).otherwise(F.col("magnitudes")).alias("magnitudes"), F.when(take, F.col("now_count")).otherwise(F.col("count")).alias("count"), outcome.alias("outcome"))


def clean_baseline(baseline: DataFrame, judged: DataFrame, channels: DataFrame) -> DataFrame:
    """Entries that could go, with the reason: stale, or of a channel that isn't declared."""
    stale = judged.where("verdict = 'stale'").select("identity_key", F.lit(True).alias("stale"))
    known = channels.select("channel", F.lit(True).alias("declared"))
    rows = baseline.join(stale, "identity_key", "left").join(known, "channel", "left")
    return rows.withColumn("reason", F.when(F.col("declared").isNull(), "undeclared").when(F.col("stale"), "stale")).where("reason IS NOT NULL").drop("stale", "declared")


def explain(subjects: DataFrame, defaults: DataFrame, overrides: DataFrame, baseline: DataFrame) -> DataFrame:
    """The boundary that holds for each subject and channel and where it comes from: baseline, inline or config.

    `defaults`: `channel`, `error`; `overrides`: `subject_key`, `channel`, `error`; `baseline` as generated.
    """
    if defaults.limit(MOST_CHANNELS + 1).count() > MOST_CHANNELS:
        raise ValueError(f"a catalogue has at most {MOST_CHANNELS} channels")
    pairs = subjects.select("subject_key").join(F.broadcast(defaults))  # each subject with each channel is the answer
    b = baseline.select(F.split("identity_key", SEPARATOR)[0].alias("subject_key"), "channel", F.array_max("magnitudes").alias("accepted"))
    b = b.groupBy("subject_key", "channel").agg(F.max("accepted").alias("accepted"))
    o = overrides.groupBy("subject_key", "channel").agg(F.max("error").alias("inline"))
    rows = pairs.join(o, ["subject_key", "channel"], "left").join(b, ["subject_key", "channel"], "left")
    source = F.when(F.col("accepted").isNotNull(), "baseline").when(F.col("inline").isNotNull(), "inline").otherwise("config")
    return rows.select("subject_key", "channel", F.coalesce("accepted", "inline", "error").alias("boundary"), source.alias("source"))


def project_findings(
    findings: DataFrame, directives: DataFrame | None = None, exclude_paths: Iterable[str] = (), exclude_namespaces: Iterable[str] = (), judged: DataFrame | None = None,
    changed: DataFrame | None = None, config_channels: Sequence[str] = (), keep_suppressed: bool = False,
) -> DataFrame:
    """Each finding once, with `removed_by`: null if it is kept, else the first stage that removes it: suppression,
    path, namespace, baseline or scope.

    Findings of `config_channels` are about the configuration and pass every stage; findings without a file aren't
    excluded by path. With `keep_suppressed` suppressed findings are restored after the baseline. Nothing is dropped,
    so removed findings can be reported.
    """
    rows = suppressed(findings, directives) if directives is not None else findings.withColumn("suppressed_by", F.lit(None).cast("bigint"))
    if judged is not None:
        rows = apply_baseline(rows, judged)
    else:
        rows = rows.withColumn("verdict", F.lit(None).cast("string"))
    if changed is not None:
        rows = in_change_scope(rows, changed)
    else:
        rows = rows.withColumn("in_scope", F.lit(True))
    config = F.col("channel").isin(*config_channels)
    by = (
        F.when(F.col("suppressed_by").isNotNull() & F.lit(not keep_suppressed), "suppression")
        .when(F.col("file").isNotNull() & path_matches(F.col("file"), exclude_paths), "path")
        .when(namespace_matches(F.col("namespace"), exclude_namespaces), "namespace")
        .when(F.col("verdict").eqNullSafe("within"), "baseline")
        .when(~F.col("in_scope"), "scope")
    )
    return rows.withColumn("removed_by", F.when(~config, by))


def exclude_by_rule(findings: DataFrame, paths: dict[str, Sequence[str]] = {}, namespaces: dict[str, Sequence[str]] = {}) -> DataFrame:  # noqa: B006
    """Findings without those of a rule (or of one of its channels) in paths or namespaces that are excluded for it."""
    from codestrata.functions.matching import any_of

    def of(name: str) -> Column:
        return (F.col("channel") == name) | (F.substring_index("channel", "#", 1) == name)

    gone = [of(r) & path_matches(F.col("file"), p) for r, p in paths.items()] + [of(r) & namespace_matches(F.col("namespace"), p) for r, p in namespaces.items()]
    return findings.where(~any_of(gone))


def uncovered(run_scope: DataFrame, recorded_scope: DataFrame) -> DataFrame:
    """Paths (`path`) of a run that no recorded path equals or contains."""
    from codestrata.operators.rollup import ancestors

    up = run_scope.select("path", F.explode(ancestors(F.regexp_replace("path", "/+$", ""), "/")).alias("up"))
    held = up.join(recorded_scope.select(F.regexp_replace("path", "/+$", "").alias("up")).distinct(), "up", "left_semi").select("path").distinct()
    return run_scope.join(held, "path", "left_anti")


def verdict(findings: DataFrame, fail_on: str = "error", complete: bool = True, config_channels: Sequence[str] = ()) -> DataFrame:
    """One row, `exit_code`: 4 for an incomplete run, else 2 for a configuration error or an error, 1 for a warning, if
    that is at or above `fail_on` (error, warning, or none: only configuration errors count), else 0."""
    if fail_on not in ("error", "warning", "none"):
        raise ValueError(f"fail_on is error, warning or none, not {fail_on!r}")
    level = {"error": 2, "warning": 1, "none": 3}[fail_on]
    worst = F.max(F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0))
    config = F.coalesce(F.max(F.col("channel").isin(*config_channels).cast("int")), F.lit(0))
    row = findings.agg(worst.alias("worst"), config.alias("config"))
    code = F.when(F.lit(not complete), 4).when(F.col("config") > 0, 2).when(F.col("worst") >= level, F.col("worst")).otherwise(0)
    return row.select(code.alias("exit_code"))


def diagnose(directives: DataFrame, channels: DataFrame, unused: DataFrame | None = None) -> DataFrame:
    """What is wrong with directives: `directive_id`, `channel`, `reason`.

    `directives`: `directive_id`, `kind` (symbol, file, next-line or threshold), `selector`, `warning`, `error`, `malformed`.
    `channels`: `channel`, `shape`, `worse`, `warning_only`: a catalogue. A selector that names no channel is unresolved; a
    threshold for occurrences only is unsupported; a malformed one, a negative one, one whose error is milder than its
    warning, and an error level for a rule that only warns, is invalid. `unused` (`directive_id`) are reported as such.
    """
    if channels.limit(MOST_CHANNELS + 1).count() > MOST_CHANNELS:
        raise ValueError(f"a catalogue has at most {MOST_CHANNELS} channels")
    known = channels.select("channel", "shape", "worse", "warning_only")
    met = directives.join(F.broadcast(known), selects(F.col("selector"), F.col("channel")), "left")
    each = met.groupBy("directive_id", "kind", "selector", "warning", "error", "malformed").agg(
        F.count("channel").alias("named"), F.count_if(F.col("shape") == "magnitude").alias("measured"),
        F.max((F.col("worse") == "lower").cast("int")).alias("lower"), F.min(F.col("warning_only").cast("int")).alias("warns"),
    )
    w, e, threshold = F.col("warning"), F.col("error"), F.col("kind") == "threshold"
    milder = F.when(F.col("lower") == 1, e > w).otherwise(e < w)
    reason = (
        F.when(threshold & F.col("malformed"), "malformed")
        .when(F.col("named") == 0, "unresolved")
        .when(threshold & (F.col("measured") == 0), "no thresholds")
        .when(threshold & ((w < 0) | (e < 0)), "negative")
        .when(threshold & (F.col("warns") == 1) & e.isNotNull(), "only warns")
        .when(threshold & milder, "error milder than warning")
    )
    codes = {"malformed": "invalid-threshold", "negative": "invalid-threshold", "only warns": "invalid-threshold", "error milder than warning": "invalid-threshold", "unresolved": "unresolved-directive", "no thresholds": "unsupported-threshold", "unused": "unused-directive"}
    channel = F.create_map(*[F.lit(x) for k, v in codes.items() for x in (k, f"annotation.{v}#annotation.{v}")])
    found = each.select("directive_id", reason.alias("reason")).where("reason IS NOT NULL")
    if unused is not None:
        found = found.unionByName(unused.join(found, "directive_id", "left_anti").select("directive_id", F.lit("unused").alias("reason")))
    return found.select("directive_id", channel[F.col("reason")].alias("channel"), "reason")

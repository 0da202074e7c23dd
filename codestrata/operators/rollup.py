"""Roll-ups of raw measurements up a hierarchy. Ancestors aggregate raw values, never aggregates of aggregates."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.operators.quantiles import percentiles

STRATEGIES = ("sum", "avg", "max", "min", "count", "p95", "p5")


def strategy(name: str, value: Column) -> Column:
    """One of the seven aggregates. Percentiles are exact, interpolated at p * (n - 1). Nulls are absent, not 0."""
    return {
        "sum": F.sum(value), "avg": F.avg(value), "max": F.max(value), "min": F.min(value), "count": F.count(value),
        "p95": F.percentile(value, [0.95, 0.05])[0], "p5": F.percentile(value, [0.95, 0.05])[1],  # one aggregate for both
    }[name]


def aggregates(value: Column, prefix: str, names: Iterable[str] = STRATEGIES) -> list[Column]:
    """Named aggregates of a value: `<prefix>_<strategy>`. An average always comes with its count."""
    wanted = list(names)
    if "avg" in wanted and "count" not in wanted:
        wanted.append("count")
    return [strategy(n, value.cast("double") if n != "count" else value).alias(f"{prefix}_{n}") for n in wanted]


def roll(facts: DataFrame, keys: Sequence[str], values: Sequence[str], names: Iterable[str] = STRATEGIES, large: bool = False) -> DataFrame:
    """All aggregates of `values` by `keys`, with partial aggregation before the shuffle. Groups without any non-null
    value have nulls and count 0. Null keys are a group.

    A percentile's buffer holds the distinct values of its group. `large` says that groups may have more of them than a
    task can hold: then the same percentiles are found by narrowing, and no group is ever in one place.
    """
    wanted = list(names)
    shares = {n: s for n, s in (("p95", 0.95), ("p5", 0.05)) if n in wanted}
    if not large or not shares:
        return facts.groupBy(*keys).agg(*[a for v in values for a in aggregates(F.col(v), v, wanted)])
    plain = [n for n in wanted if n not in shares]
    out = facts.groupBy(*keys).agg(*([a for v in values for a in aggregates(F.col(v), v, plain)] or [F.count("*").alias("_rows")]))
    for v in values:
        found = percentiles(facts, keys, v, list(shares.values()))
        wide = found.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(*[F.max(F.when(F.col("share") == s, F.col("percentile"))).alias(f"{v}_{n}") for n, s in shares.items()])
        out = out.join(wide, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], "left").drop(*[f"_k{i}" for i in range(len(keys))])
    return out.select(*keys, *[f"{v}_{n}" for v in values for n in (wanted + ["count"] if "avg" in wanted and "count" not in wanted else wanted)])


def roll_by_definition(facts: DataFrame, definitions: DataFrame, keys: Sequence[str], large: bool = False) -> DataFrame:
    """Long form: `facts` (keys, `level`, `metric`, `value`) by `definitions` (`metric`, `collected_at`, `target_level`,
    `strategy`) to keys, `target_level`, `metric` named `<metric>.<strategy>`, and `value`.

    A metric without definition, and a definition without values, give nothing; an avg definition also gives `.count`.
    `definitions` is a catalogue of metrics; it has the size of a configuration. `large` as in `roll`.
    """
    with_counts = definitions.unionByName(definitions.where("strategy = 'avg'").withColumn("strategy", F.lit("count"))).distinct()
    wanted = with_counts.groupBy(F.col("metric").alias("m"), "collected_at", "target_level").agg(F.collect_set("strategy").alias("strategies"))
    joined = facts.where("value IS NOT NULL").join(wanted, (F.col("metric") == F.col("m")) & (F.col("level") == F.col("collected_at")))
    rolled = roll(joined.select(*keys, "target_level", "metric", "value"), [*keys, "target_level", "metric"], ["value"], large=large)
    chosen = wanted.select("m", F.col("target_level").alias("t"), "strategies").distinct()
    rolled = rolled.join(chosen, (F.col("metric") == F.col("m")) & (F.col("target_level") == F.col("t")))
    kept = F.filter(F.array(*[F.struct(F.lit(n).alias("strategy"), F.col(f"value_{n}").cast("double").alias("v")) for n in STRATEGIES]), lambda x: F.array_contains("strategies", x["strategy"]))
    rows = rolled.select(*keys, "target_level", "metric", F.explode_outer(kept).alias("s"))
    return rows.select(*keys, "target_level", F.concat_ws(".", "metric", "s.strategy").alias("metric"), F.col("s.v").alias("value"))


def ancestors(path: Column, separator: str = "\\") -> Column:
    """A path and all its prefixes on separators, longest last; for '' and null the empty array."""
    parts = F.split(path, "[" + separator.replace("\\", "\\\\") + "]")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), separator))
    return F.when((path != "") & path.isNotNull(), prefixes).otherwise(F.array().cast("array<string>"))


def roll_up_paths(facts: DataFrame, path: str, values: Sequence[str], keys: Sequence[str] = (), separator: str = "\\", names: Iterable[str] = STRATEGIES, large: bool = False) -> DataFrame:
    """Every prefix of `path` (as `path`) with the aggregates of the raw values of all rows at or below it.

    Each row is sent once per level of its path at most, and partial aggregates combine that before the shuffle for all
    but the percentiles.
    """
    # an inner explode would work the prefixes out twice, for a filter on their number
    spread = facts.select(*keys, F.explode_outer(ancestors(F.col(path), separator)).alias(path), *values).where(F.col(path).isNotNull())
    return roll(spread, [*keys, path], values, names, large)


def leaves(paths: DataFrame, path: str, keys: Sequence[str] = (), separator: str = "\\") -> DataFrame:
    """The distinct paths that aren't a prefix of any other."""
    own = paths.select(*keys, path).where(F.col(path) != "").distinct()
    parent = F.substring(F.col(path), F.lit(1), F.length(path) - F.length(F.substring_index(path, separator, -1)) - len(separator))
    above = own.select(*[F.col(k).alias(f"p_{k}") for k in keys], parent.alias("p_path")).where("p_path <> ''")
    above = above.select(*[f"p_{k}" for k in keys], F.explode(ancestors(F.col("p_path"), separator)).alias("p_path")).distinct()
    return own.join(above, [*[F.col(k).eqNullSafe(F.col(f"p_{k}")) for k in keys], F.col(path) == F.col("p_path")], "left_anti")


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: mean of `value` by `weight`; rows without either don't count, no weight gives null."""
    both = value.isNotNull() & weight.isNotNull()
    return F.try_divide(F.sum(F.when(both, value * weight)), F.sum(F.when(both, weight)).cast("double"))


def override_contributions(explicit: DataFrame, derived: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `explicit`, and those of `derived` whose `keys` no explicit row has."""
    return explicit.unionByName(derived.join(explicit.select(*keys).distinct(), list(keys), "left_anti"))


def merge_right(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Union of two measurements of the same subjects in which the right one wins."""
    both = left.withColumn("_at", F.lit(0)).unionByName(right.withColumn("_at", F.lit(1)))
    return both.groupBy(*keys).agg(F.max_by(value, "_at").alias(value))


def merge_runs(left: dict[str, DataFrame], right: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Two runs (`metrics`: subject_key, metric, value; `findings`; `run`: seconds, complete) as one: measures of the right
    one win, findings are all kept, the longer time counts, and the whole is complete if both are."""
    run = left["run"].unionByName(right["run"]).agg(F.max("seconds").alias("seconds"), F.min(F.col("complete").cast("int")).cast("boolean").alias("complete"))
    return {"metrics": merge_right(left["metrics"], right["metrics"], ["subject_key", "metric"]), "findings": left["findings"].unionByName(right["findings"]), "run": run}


def namespace_rounds(callables: DataFrame, files: DataFrame, explicit: DataFrame, values: Sequence[str], file_values: Sequence[str]) -> DataFrame:
    """Namespaces in two rounds: first what callables (`project`, `namespace`, `values`) and files (`project`, `file`,
    `namespace`, `file_values`) contribute to their own namespace, an `explicit` row (`project`, `namespace`,
    `file_values`) in place of those of files; then every ancestor from the raw callables and the first round's files.

    A file that declares several namespaces is one row for each: the bridge between files and namespaces. Returned:
    `project`, `namespace`, the aggregates of `values`, and the sums of `file_values`.
    """
    own = files.groupBy("project", "namespace").agg(*[F.sum(v).alias(v) for v in file_values])
    first = override_contributions(explicit.select("project", "namespace", *file_values), own, ["project", "namespace"])
    spread = first.select("project", F.explode_outer(ancestors(F.col("namespace"))).alias("namespace"), *file_values).where("namespace IS NOT NULL")
    second = spread.groupBy("project", "namespace").agg(*[F.sum(v).alias(f"{v}_sum") for v in file_values])
    rolled = roll_up_paths(callables, "namespace", values, ["project"])
    keys = [F.col("project").eqNullSafe(F.col("_p")), F.col("namespace") == F.col("_n")]
    right = second.withColumnsRenamed({"project": "_p", "namespace": "_n"})
    out = rolled.join(right, keys, "full")
    return out.select(F.coalesce("project", "_p").alias("project"), F.coalesce("namespace", "_n").alias("namespace"), *[c for c in rolled.columns if c not in ("project", "namespace")], *[f"{v}_sum" for v in file_values])

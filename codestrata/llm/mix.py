"""Mixing sources to target weights under caps of repetition."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codestrata.session import cut

#: A leaf's records are ordered within so many buckets of their seeded hash, so that no task sorts a whole leaf.
ORDER_BUCKETS = 4096
#: Plans of at most so many leaves are sent to every task; larger ones are joined, crowded leaves being split at run time.
SENT_LEAVES = 100_000
#: Records are filtered by at most so many labels; by more they are joined.
FILTERED_LABELS = 1000


def _same(a: Sequence[str], b: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(a, b)], F.lit(True))


def _fill(nodes: DataFrame, family: Sequence[str]) -> DataFrame:
    """`nodes` with `budget`: their family's (`given`), shared by `weight`; what one can't give beyond its `capacity`
    goes to its siblings by their weights, as long as any of them can. No node gets more than its capacity.

    In order of capacity per weight, if a node were the first that isn't filled, the level reached there would be
    (given - capacities before) / weights from there on; the true level is the highest of these.
    """
    order = Window.partitionBy(*family).orderBy(F.col("capacity") / F.col("weight"))
    full = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    whole = Window.partitionBy(*family)
    level = nodes.withColumn("level", (F.col("given") - full) / rest).withColumn("level", F.max("level").over(whole))
    return level.withColumn("budget", F.greatest(F.lit(0.0), F.least("capacity", F.col("level") * F.col("weight")))).drop("level")


def plan(held: DataFrame, targets: DataFrame, levels: Sequence[str], total: float | None = None) -> DataFrame:
    """The leaves of the tree of weights: `levels`, `held`, `share` and `cap` of their target, `capacity` (all that they
    can give), `weight`, and `budget`, the tokens that they are to give.

    `held`: `levels`, from the root's children to the leaves, and `held`, the tokens of each combination. `targets`: the
    last level's column, `target_share`, `max_repeats`; null shares and caps count as 0, a label that is repeated keeps
    its largest. A target is shared by its leaves in proportion to what they hold; a node weighs what its leaves do.
    `total` is what the mix should hold; without it all tokens that any leaf with a weight and a capacity holds. Budgets
    run down from the root, so a leaf's shortage goes to its siblings, and only what a whole family can't give to the
    family's siblings. If the whole tree can't give `total`, each leaf gives its capacity. Levels may have any names but
    those of the columns returned.
    """
    inner = [f"l{i}" for i in range(len(levels))]
    leaves = _plan(held.select(*[F.col(c).alias(x) for c, x in zip(levels, inner)], "held"), targets.withColumnRenamed(levels[-1], inner[-1]), inner, total)
    return leaves.withColumnsRenamed(dict(zip(inner, levels)))


def _plan(held: DataFrame, targets: DataFrame, names: list[str], total: float | None) -> DataFrame:
    label = names[-1]
    wanted = targets.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("wanted")).agg(
        F.max(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("cap")
    )
    leaves = held.join(wanted, F.col(label) == F.col("wanted")).where("share > 0 AND cap > 0 AND held > 0").drop("wanted")
    of_label = Window.partitionBy(label)
    leaves = leaves.withColumn("capacity", F.col("held").cast("double") * F.col("cap")).withColumn("weight", F.col("share") * F.col("held") / F.sum("held").over(of_label))
    leaves = cut(leaves)
    sums = [F.sum("capacity").alias("capacity"), F.sum("weight").alias("weight")]
    root = leaves.agg(F.least(F.lit(total) if total is not None else F.sum("held").cast("double"), F.sum("capacity")).alias("given"))
    budgets = None
    for depth in range(1, len(names) + 1):
        family, mine = names[: depth - 1], names[:depth]
        nodes = leaves if depth == len(names) else leaves.groupBy(*mine).agg(*sums)
        if budgets is None:
            nodes = nodes.join(root)  # one row
        else:
            up = budgets.select(*[F.col(c).alias(f"up_{c}") for c in family], F.col("budget").alias("given"))
            nodes = nodes.join(up, _same(family, [f"up_{c}" for c in family])).drop(*[f"up_{c}" for c in family])
        budgets = _fill(nodes, family)
    return budgets.drop("given")


def mix(
    docs: DataFrame, targets: DataFrame, levels: Sequence[str], id_column: str = "doc_id", size_column: str = "tokens", total: float | None = None, seed: int = 0
) -> DataFrame:
    """The records of a mix, one row per use: the id, `levels`, `epoch` (1 is a record's first use) and the size.

    `targets`: the last level's column, `target_share`, `max_repeats` (how often a record may be used at most). Records of
    labels without a target, and of size null or below 1, take no part; a target without records gets nothing and its
    share goes to the others. Null labels at upper levels are labels. An empty table gives an empty mix. Ids should be
    unique; repeated rows are records of their own.

    Method: `plan` runs shares down the tree of levels. A leaf gives whole epochs and then the prefix, by tokens, of one
    more, in an order seeded by `seed` and the epoch. The last record of a prefix is the one whose middle is still within
    it, so each leaf is off by half a record at most.
    """
    names = [f"l{i}" for i in range(len(levels))]  # levels may be called anything
    label, targets = names[-1], targets.select(F.col(levels[-1]).alias(names[-1]), "target_share", "max_repeats")
    sized = docs.where(F.col(size_column) > 0).select(F.col(id_column).alias("id"), *[F.col(c).alias(x) for c, x in zip(levels, names)], F.col(size_column).cast("long").alias("size"))
    labels = targets.where(F.col(label).isNotNull()).select(label).distinct()
    few = [r[0] for r in labels.limit(FILTERED_LABELS + 1).collect()]
    sized = sized.where(F.col(label).isin(*few)) if len(few) <= FILTERED_LABELS else sized.join(labels, label, "left_semi")
    leaves = cut(_plan(sized.groupBy(*names).agg(F.sum("size").alias("held")), targets, names, total))
    epochs = F.least(F.col("cap").cast("int"), F.floor(F.col("budget") / F.col("held") + 1e-9).cast("int"))
    leaf = [f"p{i}" for i in range(len(names))]
    plans = leaves.select(*[F.col(c).alias(x) for c, x in zip(names, leaf)], epochs.alias("epochs"), "cap", "held", "budget")
    rest = F.when(F.col("epochs") < F.col("cap"), F.greatest(F.lit(0.0), F.least(F.col("held").cast("double"), F.col("budget") - F.col("epochs") * F.col("held")))).otherwise(0.0)
    plans = plans.select(*leaf, "epochs", rest.alias("rest"))
    if leaves.limit(SENT_LEAVES + 1).count() <= SENT_LEAVES:
        plans = F.broadcast(plans)
    records = sized.join(plans, _same(names, leaf), "inner")
    order = F.xxhash64(F.lit(seed), F.col("epochs"), F.col("id"))
    records = records.withColumn("order", order).withColumn("bucket", F.pmod("order", F.lit(ORDER_BUCKETS)))
    whole = records.where("epochs > 0").select("id", *names, F.explode(F.expr("sequence(1, epochs)")).alias("epoch"), "size")

    open_records = records.where("rest > 0")
    held_before = Window.partitionBy(*leaf).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = open_records.groupBy(*leaf, "bucket").agg(F.sum("size").alias("in_bucket"))
    buckets = buckets.select(*[F.col(c).alias(f"b{c}") for c in leaf], F.col("bucket").alias("b"), F.coalesce(F.sum("in_bucket").over(held_before), F.lit(0)).alias("before"), "in_bucket")
    placed = open_records.join(buckets, _same(leaf, [f"b{c}" for c in leaf]) & (F.col("bucket") == F.col("b"))).where(F.col("before") < F.col("rest"))
    inside = placed.where(F.col("before") + F.col("in_bucket") <= F.col("rest"))
    running = Window.partitionBy(*leaf, "bucket").orderBy("order", "id").rowsBetween(Window.unboundedPreceding, 0)
    edge = placed.where(F.col("before") + F.col("in_bucket") > F.col("rest")).withColumn("upto", F.col("before") + F.sum("size").over(running))
    edge = edge.where(F.col("upto") - F.col("size") / 2 <= F.col("rest"))
    last = [part.select("id", *names, (F.col("epochs") + 1).alias("epoch"), "size") for part in (inside, edge)]
    used = whole.unionByName(last[0]).unionByName(last[1])
    return used.select(F.col("id").alias(id_column), *[F.col(x).alias(c) for c, x in zip(levels, names)], "epoch", F.col("size").alias(size_column))


def shares(mixed: DataFrame, docs: DataFrame, targets: DataFrame, label: str, size_column: str = "tokens") -> DataFrame:
    """One row per target: `target_share`, `max_repeats`, `held_tokens`, `used_tokens`, `reached_share`, and `outcome`:
    absent (nothing is held), exhausted (all of it is used as often as it may be), above or below (the reached share, by
    more than a thousandth: it took over shortages of others), or met."""
    held = docs.where(F.col(size_column) > 0).groupBy(label).agg(F.sum(size_column).alias("held_tokens"))
    used = mixed.groupBy(label).agg(F.sum(size_column).alias("used_tokens"))
    whole = mixed.agg(F.sum(size_column).alias("whole"))
    rows = targets.join(held, label, "left").join(used, label, "left").join(whole)  # whole is one row
    zero = F.lit(0).cast("long")
    rows = rows.select(
        label, "target_share", "max_repeats", F.coalesce("held_tokens", zero).alias("held_tokens"), F.coalesce("used_tokens", zero).alias("used_tokens"),
        F.coalesce(F.try_divide("used_tokens", "whole"), F.lit(0.0)).alias("reached_share"),
    )
    off = F.col("reached_share") - F.col("target_share")
    return rows.withColumn(
        "outcome",
        F.when(F.col("held_tokens") == 0, "absent").when(F.col("used_tokens") >= F.col("held_tokens") * F.col("max_repeats"), "exhausted")
        .when(off > 0.001, "above").when(off < -0.001, "below").otherwise("met"),
    )

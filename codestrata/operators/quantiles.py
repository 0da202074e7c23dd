"""Exact percentiles of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codestrata.session import cut

#: Buckets by which a group's values are narrowed down in a round, and rows of a group that are sorted at last.
BUCKETS, FEW = 1024, 100_000
#: Values of a group that one aggregation buffer may hold, some 64 bytes each; groups with more are narrowed down.
HELD = 500_000
#: Up to so many open intervals are sent to every task.
SENT_RANKS = 100_000


def percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], few: int = FEW, buckets: int = BUCKETS, held: int = HELD) -> DataFrame:
    """Keys, `share` and `percentile`: each share's exact percentile, interpolated at share * (n - 1).

    Nulls and NaN don't count; infinite values are errors of the caller. A group without values gives no rows. Null
    keys are a group. An empty table gives an empty table.

    Groups that are counted to have at most `held` values are aggregated. In others the two ranks around each percentile
    are looked for by narrowing: each round counts the values of every group in
    equal parts of its remaining interval (partial counts before the shuffle, `buckets` rows a group at most), and
    keeps the part that has the rank. Only when at most `few` values of a group remain, or all that remain are equal,
    they are sorted; so no task ever holds a large group, and each round reads the values once.
    """
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(*keys, v.alias("v"))
    every = cut(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    large = every.where(F.col("n") > held)
    some = large.limit(SENT_RANKS + 1).count()
    small_rows = rows
    if some:
        marked = large.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)])
        marked = F.broadcast(marked) if some <= SENT_RANKS else marked
        same = [F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)]
        small_rows, rows = (rows.join(marked, same, how) for how in ("left_anti", "left_semi"))
    at_once = small_rows.groupBy(*keys).agg(F.percentile("v", F.array(*[F.lit(float(s)) for s in shares])).alias("p"))
    pairs_of = F.arrays_zip(F.array(*[F.lit(float(s)) for s in shares]).alias("share"), F.col("p").alias("percentile"))
    small = at_once.select(*keys, F.explode(pairs_of).alias("x")).select(*keys, "x.share", "x.percentile")
    if not some:
        return small
    return small.unionByName(_narrowed(rows, large, keys, shares, few, buckets))


def _narrowed(rows: DataFrame, ends: DataFrame, keys: Sequence[str], shares: Sequence[float], few: int, buckets: int) -> DataFrame:
    at = F.col("share") * (F.col("n") - 1)
    wanted = ends.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    ranks = wanted.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at)))))
    open_ranks = cut(ranks.select(*keys, "rank", "lo", "hi", F.lit(0).cast("long").alias("before"), F.col("n").alias("inside")).distinct())
    names = [f"_k{i}" for i in range(len(keys))]
    settled = None

    def match(left: DataFrame, right: DataFrame) -> DataFrame:
        # the open intervals are few for large groups; a range behind equal keys would send a group's values to one task
        if right.limit(SENT_RANKS + 1).count() <= SENT_RANKS:
            right = F.broadcast(right)
        cond = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
        return left.join(right, cond + [(F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))])

    def renamed(part: DataFrame) -> DataFrame:
        return part.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], *[c for c in part.columns if c not in keys])

    while True:
        point = open_ranks.where("lo = hi").select(*keys, "rank", F.col("lo").alias("v"))
        small = renamed(open_ranks.where(f"lo < hi AND inside <= {few}"))
        order = Window.partitionBy(*names, "rank").orderBy("v")
        picked = match(rows, small).withColumn("r", F.row_number().over(order) - 1 + F.col("before")).where("r = rank").select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "rank", "v")
        done = cut(point.unionByName(picked))
        settled = done if settled is None else settled.unionByName(done)
        large = open_ranks.where(f"lo < hi AND inside > {few}")
        if large.isEmpty():
            break
        spans = renamed(large.select(*keys, "lo", "hi").distinct())
        part = F.least(F.lit(buckets - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets).cast("int"))
        counted = match(rows, spans).groupBy(*names, "lo", "hi", part.alias("part")).agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        upto = Window.partitionBy(*names, "lo", "hi").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        placed = counted.withColumn("held", F.coalesce(F.sum("c").over(upto), F.lit(0))).withColumnsRenamed({"lo": "plo", "hi": "phi"})
        cond = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)] + [F.col("lo") == F.col("plo"), F.col("hi") == F.col("phi")]
        found = large.join(placed, cond).where((F.col("rank") >= F.col("before") + F.col("held")) & (F.col("rank") < F.col("before") + F.col("held") + F.col("c")))
        open_ranks = cut(found.select(*keys, "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("before") + F.col("held")).alias("before"), F.col("c").alias("inside")))
    values = renamed(settled).withColumnRenamed("v", "at_rank")
    pairs = wanted.join(values, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)] + [F.col("rank").between(F.floor(at), F.ceil(at))])
    low, high = F.min("at_rank"), F.max("at_rank")
    return pairs.groupBy(*keys, "share", "n").agg(low.alias("low"), high.alias("high")).select(*keys, "share", (F.col("low") + (F.col("high") - F.col("low")) * (at - F.floor(at))).alias("percentile"))

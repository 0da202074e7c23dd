"""The best N items of every group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def bounded_heap(item: Column, size: int) -> Column | None:
    """Aggregate: the `size` smallest of `item`, in order, from a heap that never holds more than `size`.

    Spark has this aggregate (its matrix factorisation ranks with it) under an internal name. Each task fills one heap
    per group before the shuffle; only heaps are sent and merged. None where the name isn't to be had: in a session
    over the network, or in a version that lacks it.
    """
    try:
        from pyspark import SparkContext
        from pyspark.sql.classic.column import _to_java_column, _to_seq

        sc = SparkContext._active_spark_context
        columns = getattr(getattr(sc._jvm, "org.apache.spark.sql.Column$"), "MODULE$")
        return Column(columns.internalFn("collect_top_k", _to_seq(sc, [item, F.lit(size), F.lit(True)], _to_java_column)))
    except Exception:  # noqa: BLE001 - whatever is missing, the other way gives the same rows
        return None


def top_n(df: DataFrame, groups: Sequence[Column], score: Column, ties: Sequence[Column], keep: Sequence[Column], n: int) -> DataFrame:
    """The `n` rows of each group with the highest `score`, ties by `ties` ascending (strings in byte order).

    `groups` and `keep` are named columns, `score` a double. Returned: the groups, `rank` from 1, `score`, and `keep`.
    Rows whose score is null, NaN or infinite are no candidates. `ties` should end in something unique; rows that are
    equal in score and in all of `ties` are taken in the order of `keep`, so the result is the same in any order of
    arrival. Null groups are groups; null ties come first. A group with fewer than `n` candidates gives all of them,
    an empty table none. A group of any size costs a task `n` rows of memory and sends `n` rows. Other columns of `df`
    are not read.

    Where Spark's own heap can't be had, ranks limited before and after the shuffle give the same rows: each task then
    sorts what it holds of a group, and sends `n` rows.
    """
    finite = df.where(score.isNotNull() & ~F.isnan(score) & (F.abs(score) != float("inf")))
    item = F.struct((-score).alias("s"), F.struct(*[c.alias(f"t{i}") for i, c in enumerate(ties)]).alias("t"), F.struct(*keep).alias("k"))
    heap = bounded_heap(item, n)
    if heap is None:
        rows = finite.select(*groups, item.alias("_item"))
        named = [F.col(f"`{c}`") for c in rows.columns[: len(groups)]]
        ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*named).orderBy("_item"))).where(F.col("rank") <= n)
        return ranked.select(*named, "rank", (-F.col("_item.s")).alias("score"), "_item.k.*")
    heaps = finite.groupBy(*groups).agg(heap.alias("_heap"))
    group_names = [F.col(f"`{c}`") for c in heaps.columns[: len(groups)]]
    rows = heaps.select(*group_names, F.posexplode("_heap").alias("_at", "_item"))
    return rows.select(*group_names, (F.col("_at") + 1).alias("rank"), (-F.col("_item.s")).alias("score"), "_item.k.*")

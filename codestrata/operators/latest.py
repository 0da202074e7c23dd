"""The current version of each keyed row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column], values: Sequence[str | Column]) -> DataFrame:
    """One row per key: `keys` and the `values` of its row that is largest by `order`.

    A partial aggregate runs before the shuffle, so that a key that is delivered over and over sends one row a task.
    Null keys form a key of their own; a null in `order` counts as the smallest. Rows that tie in all of `order` are
    decided by the values themselves (largest first), so that the result never depends on arrival. An empty table
    gives an empty table. Columns of `df` that are named neither as key nor as value are dropped before the shuffle.
    """
    named = [c if isinstance(c, Column) else F.col(c) for c in keys]
    ranked = [(c if isinstance(c, Column) else F.col(c)).alias(f"o{i}") for i, c in enumerate(order)]
    kept = [c if isinstance(c, Column) else F.col(c) for c in values]
    best = F.max(F.struct(*ranked, F.struct(*kept).alias("row"))).alias("_best")
    return df.groupBy(*named).agg(best).select("*", "_best.row.*").drop("_best")

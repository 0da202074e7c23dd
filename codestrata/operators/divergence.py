"""Differences between two copies of the same data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What counts as a number in text; Java's own parser would also take 1d, 0x1p3 and NaN.
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def finite_number(text: Column) -> Column:
    """The finite number that `text` spells, else null; surrounding white space doesn't count. 1e999 is not finite."""
    trimmed = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return finite(F.when(trimmed.rlike(NUMBER), trimmed.try_cast("double")))


def finite(value: Column) -> Column:
    """`value`, or null where it is NaN or infinite; -0 becomes 0."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value + F.lit(0.0))


def except_all_both(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`left EXCEPT ALL right` and `right EXCEPT ALL left` in one pass: `columns` and `side` ('left' or 'right').

    EXCEPT ALL is by definition the rows whose signed count is above zero, that many times; the other direction is the
    same count below zero. So one signed count over both tables serves both, and rows that agree cancel before and
    after the shuffle. Nulls equal nulls, repeated rows count as often as they stand, empty tables are fine.
    """
    marked = left.select(*columns, F.lit(1).alias("_sign")).unionByName(right.select(*columns, F.lit(-1).alias("_sign")))
    counted = marked.groupBy(*columns).agg(F.sum("_sign").alias("_net")).where("_net <> 0")
    return counted.select(
        *columns,
        F.when(F.col("_net") > 0, "left").otherwise("right").alias("side"),
        F.explode(F.sequence(F.lit(1), F.abs("_net"))).alias("_copy"),
    ).drop("_copy")


def divergence(left: DataFrame, right: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """What two tables (`item`, `field`, `value` double) say differently.

    Each table has at most one row for an item and field, already normalised. Returned: `kind`, `item`, `field`,
    `left_value`, `right_value`. Kinds: `left_only` and `right_only`, an item of which the other table has no row at
    all (`field` and values null, one row an item); `differs`, a field of an item in both, of which one value is
    missing and the other isn't, or the two lie more than `tolerance` apart. A null value and no row are the same
    missing value. A null item or field is a key like others. NaN counts as missing.

    Method: rows are normalised and each item gets a row that says that it is there; EXCEPT ALL in both directions
    leaves two residues; a full join of the residues by key gives field differences, and items whose own row is in a
    residue are one-sided. Everything but the residues is gone after one aggregate, however large the tables are.
    """

    def rows(df: DataFrame) -> DataFrame:
        clean = df.select("item", "field", finite(F.col("value")).alias("value"), F.lit(False).alias("whole"))
        there = clean.groupBy("item").agg(F.lit(True).alias("whole")).select("item", F.lit(None).cast("string").alias("field"), F.lit(None).cast("double").alias("value"), "whole")
        return clean.unionByName(there)

    residue = except_all_both(rows(left), rows(right), ["item", "field", "value", "whole"])
    alone = residue.where("whole")
    one_sided = alone.select(F.concat("side", F.lit("_only")).alias("kind"), "item", "field", F.col("value").alias("left_value"), F.col("value").alias("right_value"))
    fields = residue.where("NOT whole")
    a = fields.where("side = 'left'").select(F.col("item").alias("li"), F.col("field").alias("lf"), F.col("value").alias("left_value"))
    b = fields.where("side = 'right'").select(F.col("item").alias("ri"), F.col("field").alias("rf"), F.col("value").alias("right_value"))
    joined = a.join(b, a.li.eqNullSafe(b.ri) & a.lf.eqNullSafe(b.rf), "full").select(
        F.coalesce("li", "ri").alias("item"), F.coalesce("lf", "rf").alias("field"), "left_value", "right_value"
    )
    apart = (
        (F.col("left_value").isNull() != F.col("right_value").isNull())
        | F.coalesce(F.abs(F.col("left_value") - F.col("right_value")) > tolerance, F.lit(False))
    )
    lone = alone.select(F.col("item").alias("lone"))
    kept = joined.where(apart)
    both = kept.join(lone, kept.item.eqNullSafe(lone.lone), "left_anti")
    return one_sided.unionByName(both.select(F.lit("differs").alias("kind"), "item", "field", "left_value", "right_value"))

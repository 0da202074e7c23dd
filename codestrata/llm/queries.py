"""The llm queries by name; __spark_entry__.py adds them to the core's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm.encode import decode, encode, token_counts
from codestrata.llm.mix import mix, plan, shares
from codestrata.llm.split import split_oversized
from codestrata.llm.syntax import check_syntax, rates
from codestrata.llm.topn import top_n
from codestrata.operators.latest import latest
from codestrata.session import cut
from codestrata.tables import table

TOP_CALLABLES = 3  # cases per owner, as TESTDATA.md states them


def callables(spark: SparkSession, folder: str) -> DataFrame:
    """Current rows of methods and functions with their owner: project, type, name, symbol_id, mi, owner."""
    rows = table(spark, folder, "symbols").where(F.col("type").isin("method", "function") & F.col("name").isNotNull())
    current = latest(rows, ["project", "type", "name"], ["collected_at", "symbol_id"], ["symbol_id", F.col("metrics.mi").alias("mi")])
    at = F.when(F.col("type") == "method", F.instr("name", "::")).otherwise(
        F.length("name") - F.length(F.substring_index("name", "\\", -1))
    )
    return current.withColumn("owner", F.when(at > 0, F.expr("name").substr(F.lit(1), at - 1)).otherwise(""))


def p1_top_callables(spark: SparkSession, folder: str) -> DataFrame:
    rows = callables(spark, folder)
    groups = [F.col("project"), F.col("type"), F.col("owner")]
    best = top_n(rows, groups, F.col("mi"), [F.col("name"), F.col("symbol_id")], [F.col("name"), F.col("symbol_id")], TOP_CALLABLES)
    return best.withColumnRenamed("score", "mi")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_top_callables(spark, folder).select("symbol_id")


def p3_files(spark: SparkSession, folder: str) -> DataFrame:
    return check_syntax(table(spark, folder, "documents"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_files(spark, folder).where("NOT valid").select("doc_id")


def p3_rates(spark: SparkSession, folder: str) -> DataFrame:
    return rates(check_syntax(table(spark, folder, "documents"), keep=["repo"]))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode(table(spark, folder, "documents"))


def p6_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents, by language, come back from their ids as the text they were."""
    docs = table(spark, folder, "documents")
    back = decode(encode(docs)).withColumnRenamed("text", "back")
    same = docs.join(back, "doc_id", "left").withColumn("same", F.col("back").eqNullSafe(F.coalesce("text", F.lit(""))))
    return same.groupBy("lang").agg(F.count("*").alias("documents"), F.count_if("same").alias("same"))


MIX_LEVELS = ("doc_kind", "lang", "source")  # domain, language, source; targets are given for sources
MIX_SEED = 20250101


def _sized(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's token count; texts are encoded once and left behind."""
    return cut(token_counts(table(spark, folder, "documents").select("doc_id", *MIX_LEVELS, "text")).drop("text"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix(_sized(spark, folder), table(spark, folder, "mix_targets"), MIX_LEVELS, seed=MIX_SEED)


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    docs, targets = _sized(spark, folder), table(spark, folder, "mix_targets")
    return shares(cut(mix(docs, targets, MIX_LEVELS, seed=MIX_SEED)), docs, targets, "source")


def p7_budgets(spark: SparkSession, folder: str) -> DataFrame:
    """The tree of weights with characters for tokens: what each leaf holds, can give, and is to give."""
    held = table(spark, folder, "documents").where("n_chars > 0").groupBy(*MIX_LEVELS).agg(F.sum("n_chars").alias("held"))
    leaves = plan(held, table(spark, folder, "mix_targets"), MIX_LEVELS)
    return leaves.select(*MIX_LEVELS, "held", "capacity", F.round("budget", 3).alias("budget"))


def p8_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_oversized(table(spark, folder, "documents"), table(spark, folder, "split_limits"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that the splitter cuts: each has a first piece."""
    pieces = split_oversized(table(spark, folder, "documents"), table(spark, folder, "split_limits"), with_text=False)
    return pieces.where("piece = 0").select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_top_callables": p1_top_callables,
    "p3_found": p3_found,
    "p3_files": p3_files,
    "p3_rates": p3_rates,
    "p6_ids": p6_ids,
    "p6_roundtrip": p6_roundtrip,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p7_budgets": p7_budgets,
    "p8_found": p8_found,
    "p8_pieces": p8_pieces,
}

"""Measurements taken from the source files among the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions.text import is_sensitive_name
from codestrata.operators.graph import class_coupling
from codestrata.plans.base import rounded
from codestrata.sources.files import coverage, edges_of, php_facts
from codestrata.functions.text import is_generated
from codestrata.tables import table


def _files(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").where(F.lower("path").rlike(r"\.(php|inc|phtml)$") & F.col("text").isNotNull())
    return rows.select(F.col("doc_id").cast("string").alias("file"), "text", is_generated(F.col("text")).alias("is_generated"))


def _facts(spark: SparkSession, folder: str) -> DataFrame:
    return php_facts(_files(spark, folder))


def php_callables(spark: SparkSession, folder: str) -> DataFrame:
    rows = _facts(spark, folder).where("kind = 'callable'")
    names = ("ccn", "cognitive", "npath", "statements", "parameters", "unreachable", "mi", "halstead.volume", "halstead.difficulty", "halstead.effort", "halstead.bugs", "halstead.time")
    return rounded(rows.select("file", "subject", "line", F.col("extra")["kind"].alias("callable_kind"), *[F.col("values")[n].alias(n.replace(".", "_")) for n in names]))


def php_classes(spark: SparkSession, folder: str) -> DataFrame:
    rows = _facts(spark, folder).where("kind = 'class'")
    names = ("lcom", "tcc", "lcc", "rfc", "wmc", "methodCount", "propertyCount", "classLoc", "woc", "isDataClass", "typeCoverage.pct", "unusedPrivate", "constructorParameters")
    return rounded(rows.select("file", "subject", "line", F.col("extra")["kind"].alias("class_kind"), *[F.col("values")[n].alias(n.replace(".", "_")) for n in names]))


def php_coupling(spark: SparkSession, folder: str) -> DataFrame:
    projects = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("file"), F.col("repo").alias("project"))
    return rounded(class_coupling(edges_of(_facts(spark, folder), projects)))


def php_rows(spark: SparkSession, folder: str) -> DataFrame:
    """How many facts of each kind there are, entries by what they are, and in how many files."""
    rows = _facts(spark, folder)
    sensitive = (F.col("kind") == "parameter") & (F.col("extra")["sensitive"] == "false") & is_sensitive_name(F.col("subject"))
    kind = F.when(F.col("kind").isin("entry", "directive"), F.concat_ws(" ", "kind", "subject")).when(sensitive, "entry sensitive_parameter").otherwise(F.col("kind"))
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("facts"), F.countDistinct("file").alias("files"))


def php_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Each file is analysed, generated or failed, and none is missing."""
    return coverage(_files(spark, folder), _facts(spark, folder)).groupBy("status").agg(F.count("*").alias("files"))


QUERIES = {f.__name__: f for f in (php_callables, php_classes, php_coupling, php_rows, php_coverage)}
ORACLE: dict[str, str] = {}

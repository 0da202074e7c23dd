"""Baselines as JSON: {"version", "generated", "scope", "entries": {subject: [{channel, occurrence?, edge?, magnitudes |
count, mode?}]}}."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators.policy import SEPARATOR

VERSION = 13  # fixed value: of the format written here
_ENTRY = "array<struct<channel:string,occurrence:string,edge:struct<target:string,type:string>,magnitudes:array<double>,count:int,mode:string>>"


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """`identity_key`, `channel`, `magnitudes`, `count`, `inert`: why an entry has no effect, else null. A malformed
    entry is inert, not an error; a file that is no JSON object has no entries."""
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.from_json("value", f"version int, entries map<string,{_ENTRY}>").alias("doc"))
    return _entries(parsed.select(F.col("doc.version").alias("version"), F.explode("doc.entries").alias("subject_key", "list")))


def read_lines(lines: DataFrame, version: int = VERSION) -> DataFrame:
    """The entries of `lines` (`value`) as `baseline_json` gives them, in the columns of `read_baseline`."""
    parsed = lines.select(F.from_json("value", f"map<string,{_ENTRY}>").alias("doc"))
    return _entries(parsed.select(F.lit(version).alias("version"), F.explode("doc").alias("subject_key", "list")))


def _entries(lists: DataFrame) -> DataFrame:
    rows = lists.select("version", "subject_key", F.explode("list").alias("e"))
    none = F.lit("")
    key = F.concat_ws(SEPARATOR, "subject_key", "e.channel", F.coalesce("e.occurrence", none), F.coalesce("e.edge.target", none), F.coalesce("e.edge.type", none))
    size = F.when(F.col("e.magnitudes").isNotNull(), F.size("e.magnitudes")).otherwise(F.col("e.count"))
    why = F.when(F.col("e.channel").isNull(), "no channel").when(size.isNull(), "neither magnitudes nor count").when(size < 1, "empty")
    return rows.select(key.alias("identity_key"), F.col("e.channel").alias("channel"), F.array_sort("e.magnitudes").alias("magnitudes"), size.cast("long").alias("count"), why.alias("inert"), "version")


def baseline_json(baseline: DataFrame) -> DataFrame:
    """Lines `{subject: [entries]}` of a generated baseline, one per subject, with occurrence and edge where there are any."""
    parts = F.split("identity_key", SEPARATOR)
    edge = F.when((parts[3] != "") | (parts[4] != ""), F.struct(parts[3].alias("target"), parts[4].alias("type")))
    measured = F.filter("magnitudes", lambda m: m.isNotNull())
    entry = F.struct("channel", F.nullif(parts[2], F.lit("")).alias("occurrence"), edge.alias("edge"), F.when(F.size(measured) > 0, measured).alias("magnitudes"), "count")
    rows = baseline.select(parts[0].alias("subject"), entry.alias("entry")).groupBy("subject").agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    return rows.select(F.to_json(F.create_map("subject", "entries")).alias("value"))


def content_hash(lines: DataFrame) -> str:
    """A hash of a baseline's lines that doesn't depend on their order: what a writer compares before it replaces one."""
    low, n = lines.agg(F.sum(F.conv(F.substring(F.sha2("value", 256), 1, 12), 16, 10).cast("decimal(38,0)")), F.count("*")).first()
    return f"{int(low or 0):x}-{n}"


def write_baseline(lines: DataFrame, path: str, expected: str | None = None) -> str:
    """Write lines as a new baseline at `path` and return their hash.

    `expected` is the hash of the baseline that the lines were made from, null if there was none. If another one is there
    now, nothing is written and an error says so. The lines go to a folder beside, which is renamed over the old one.
    """
    spark = lines.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    now = content_hash(spark.read.text(path)) if system.exists(folder) else None
    if now != expected:
        raise RuntimeError(f"the baseline at {path} is another one by now")
    beside = spark._jvm.org.apache.hadoop.fs.Path(path + ".next")
    lines.select("value").write.mode("overwrite").text(path + ".next")
    written = content_hash(spark.read.text(path + ".next"))
    system.delete(folder, True)
    if not system.rename(beside, folder):
        raise RuntimeError(f"could not rename {path}.next")
    return written


def migrate(old: DataFrame, symbols: DataFrame) -> DataFrame:
    """Entries of the oldest format (`file`, `rule`, `symbol`, one row a finding) in today's columns, by the subject that
    `symbols` (`file`, `symbol`, `subject_key`) gives; `reason` says why one can't be carried over, else null.

    That format had no magnitudes: entries count findings. A rule's code is taken to be its name.
    """
    counts = old.groupBy("file", "rule", "symbol").agg(F.count("*").alias("count"))
    known = symbols.groupBy(F.col("file").alias("sf"), F.col("symbol").alias("ss")).agg(F.min("subject_key").alias("subject_key"), F.count_distinct("subject_key").alias("n"))
    rows = counts.join(known, F.col("file").eqNullSafe(F.col("sf")) & F.col("symbol").eqNullSafe(F.col("ss")), "left")
    channel = F.concat_ws("#", "rule", "rule")
    key = F.concat_ws(SEPARATOR, F.coalesce("subject_key", F.lit("")), channel, F.lit(""), F.lit(""), F.lit(""))
    reason = F.when(F.col("subject_key").isNull(), "unknown symbol").when(F.col("n") > 1, "ambiguous symbol").when(F.col("rule").isNull(), "no rule")
    return rows.select(key.alias("identity_key"), channel.alias("channel"), F.array().cast("array<double>").alias("magnitudes"), "count", reason.alias("reason"))

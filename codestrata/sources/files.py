"""Files as tables: discovery, the generated-file split, and fact rows from PHP sources."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.frontend.php_facts import facts
from codestrata.frontend.php_lexer import tokens as lexed
from codestrata.functions.matching import path_matches
from codestrata.functions.text import is_generated

EXCLUDED = ("vendor", "node_modules", ".git")  # fixed value: directories that are never read


def discover(spark: SparkSession, paths: Sequence[str], suffix: str = ".php", excluded: Iterable[str] = EXCLUDED) -> DataFrame:
    """`file`, `text`, `is_generated` of the files below the paths, each once; contents are read when they are used."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(list(paths))
    inside = F.lit(False)
    for d in excluded:
        inside = inside | F.contains(F.col("path"), F.lit(f"/{d}/"))
    text = F.make_valid_utf8(F.col("content").cast("string"))  # bytes that are no UTF-8 become replacement characters
    return rows.where(~inside).select(F.regexp_replace("path", "^file:/*", "/").alias("file"), text.alias("text")).dropDuplicates(["file"]).withColumn("is_generated", is_generated(F.col("text")))


FACTS = "file string, kind string, subject string, owner string, line int, values map<string,double>, extra map<string,string>"


def php_facts(files: DataFrame) -> DataFrame:
    """Fact rows of PHP files (`file`, `text`), all kinds in one pass; a file that can't be read is one `failure` row,
    as is one with a null text. Filters on `kind` run after the parser, filters on files belong before it."""

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(file, *row) for file, text in batch[["file", "text"]].itertuples(index=False) for row in (facts(text) if text is not None else [("failure", "", "", 0, {}, {})])]
            yield pd.DataFrame(rows, columns=["file", "kind", "subject", "owner", "line", "values", "extra"])

    return files.select(F.col("file").cast("string").alias("file"), "text").mapInPandas(measured, FACTS)


def php_tokens(files: DataFrame) -> DataFrame:
    """`file`, `tokens` and `lines` of PHP files: what duplicates are looked for in. No white space, comments or tags;
    variables are $_, strings '_', numbers 0. A null text, and one of which no tokens can be made, have none."""
    same = {"VAR": "$_", "ENC_VAR": "$_", "STR": "'_'", "DQ_OPEN": "'_'", "INT": "0", "FLOAT": "0"}
    skipped = ("HTML", "OPEN_ECHO", "DQ_CLOSE", "BAD")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file, text in batch[["file", "text"]].itertuples(index=False):
                found = [(same.get(k, t), line) for k, t, line in (lexed(text) if text is not None else []) if k not in skipped and not t.startswith("?>")]
                out.append((file, [t for t, _ in found], [line for _, line in found]))
            yield pd.DataFrame(out, columns=["file", "tokens", "lines"])

    return files.select(F.col("file").cast("string").alias("file"), "text").mapInPandas(read, "file string, tokens array<string>, lines array<int>")


def new_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """`files` whose content isn't among `known` fact tables, by the hash of the text (`content_hash`)."""
    hashed = files.withColumn("content_hash", F.xxhash64("text"))
    return hashed.join(known.select("content_hash").distinct(), "content_hash", "left_anti")


def coverage(files: DataFrame, rows: DataFrame) -> DataFrame:
    """Each file once with `status`: generated, failed or analysed. A file without rows is missing."""
    failed = rows.groupBy("file").agg(F.max(F.col("kind") == "failure").alias("failed"))
    status = F.when(F.col("is_generated"), "generated").when(F.col("failed").isNull(), "missing").when(F.col("failed"), "failed").otherwise("analysed")
    return files.join(failed, "file", "left").select("file", status.alias("status"))


def edges_of(rows: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """Dependency edges of fact rows in the columns of the graph operators. `projects` (`file`, `project`) says whose a
    file is, so that classes of one name in two projects stay two; without it all files are one project, ''."""
    from codestrata.plans.base import above

    e = rows.where("kind = 'edge'")
    e = e.withColumn("project", F.lit("")) if projects is None else e.join(projects.select("file", "project"), "file", "left")
    src, dst = F.col("subject"), F.col("owner")
    return e.select(
        "project", F.concat(F.lit("declaration:class:"), src, F.lit("@"), F.col("file")).alias("src_decl"), src.alias("src_class"), above(src).alias("src_ns"),
        dst.alias("dst_class"), above(dst).alias("dst_ns"), F.col("extra")["dep_type"].alias("dep_type"), "file", "line",
    )


def in_paths(files: DataFrame, patterns: Iterable[str]) -> DataFrame:
    return files.where(path_matches(F.col("file"), patterns))

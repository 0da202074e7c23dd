"""Line counts, markers and clones in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions import text as tx
from codestrata.operators import clones
from codestrata.session import cut
from codestrata.tables import table


def _sources(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("doc_kind = 'source_code' AND text IS NOT NULL")


def loc_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", tx.line_counts(F.col("text")).alias("n")).select("doc_id", "n.*")


def generated_files(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").groupBy("lang").agg(F.count("*").alias("files"), F.count_if(tx.is_generated(F.col("text"))).alias("generated"))


K = 40  # tokens, the least that counts as a clone here, where files are short; runs take 70


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """PHP files by language or by the end of the path, since either may be null."""
    rows = _sources(spark, folder).where((F.col("lang") == "php") | F.lower("path").rlike(r"\.(php|inc|phtml)$"))
    return rows.select(F.col("doc_id").alias("file"), clones.normal_tokens(F.col("text")).alias("tokens"))


def clone_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Each file whose tokens another file has too, with the first of its class."""
    return clones.copies(_files(spark, folder), K).where("files > 1")


def clone_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Equal runs of tokens between files that aren't whole copies of each other; `clone_copies` has the copies."""
    files = cut(clones.representatives(_files(spark, folder), K))
    return clones.verified(clones.clone_pairs(files, K), files)


def clone_blocks(spark: SparkSession, folder: str) -> DataFrame:
    files = cut(clones.representatives(_files(spark, folder), K))
    return clones.clone_blocks(clones.clone_pairs(files, K), files).select("block", "tokens", F.size("places").alias("places"))


QUERIES = {f.__name__: f for f in (loc_counts, generated_files, clone_copies, clone_pairs, clone_blocks)}
ORACLE = {
    "loc_counts": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, count(*) AS loc, count(*) FILTER (WHERE regexp_full_match(t, '[ \t\n\x0B\f\r]*')) AS blank, count(*) FILTER (WHERE regexp_matches(t, '^[ \t\n\x0B\f\r]*(//|#($|[^\[])|/\*|\*)')) AS cloc FROM l GROUP BY ALL)
SELECT doc_id, coalesce(loc, 0)::INT AS loc, coalesce(blank, 0)::INT AS blank, coalesce(cloc, 0)::INT AS cloc, coalesce(loc - blank - cloc, 0)::INT AS lloc FROM documents LEFT JOIN c USING (doc_id)""",
    "generated_files": r"""SELECT lang, count(*) AS files, count(*) FILTER (WHERE regexp_matches(substr(text, 1, 2048), '(?im)(^[ \t\n\x0B\f\r]*(//|#|/\*|\*)|/\*).*@generated\b')) AS generated FROM documents GROUP BY ALL""",
}

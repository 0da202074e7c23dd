"""Problem 4: class declarations to full hierarchies."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators.hierarchy import Forest, decompose
from codestrata.operators.latest import latest
from codestrata.tables import table


#: Unicode's white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def class_name(name: Column) -> Column:
    """ASCII lower case, no white space around, single backslashes, none in front."""
    trimmed = F.btrim(name, F.lit(WHITE))
    single = F.when(F.contains(trimmed, F.lit("\\\\")), F.regexp_replace(trimmed, r"\\+", r"\\")).otherwise(trimmed)
    bare = F.ltrim(single, F.lit("\\"))
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def class_forest(spark: SparkSession, folder: str) -> Forest:
    rows = table(spark, folder, "class_decls").where(F.col("fqcn").isNotNull())
    rows = rows.select(F.col("project").alias("scope"), class_name(F.col("fqcn")).alias("id"), F.nullif(class_name(F.col("extends")), F.lit("")).alias("parent"), "recorded_at")
    return decompose(latest(rows, ["scope", "id"], ["recorded_at"], ["parent"]))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    nodes = class_forest(spark, folder).nodes.where("declared AND has_parent")
    return nodes.select(
        F.col("scope").alias("project"), F.col("id").alias("fqcn"), F.coalesce("root", F.lit("")).alias("root"),
        F.when(F.col("cycle") == "on", -1).when(F.col("cycle") == "into", -2).otherwise(F.col("depth")).cast("long").alias("depth"),
    )


def p4_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Each class in a tree, declared or not, with its path from the root and the number of its descendants."""
    rows = class_forest(spark, folder).paths()
    return rows.select(F.col("scope").alias("project"), F.col("id").alias("fqcn"), F.array_join("path", " > ").alias("path"), "depth", (F.col("size") - 1).alias("descendants"))


def p4_descendants(spark: SparkSession, folder: str) -> DataFrame:
    return class_forest(spark, folder).descendants().select(F.col("scope").alias("project"), F.col("id").alias("fqcn"), "descendant", "below")


NAME_SQL = r"translate(regexp_replace(regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '\\+', '\\', 'g'), '^\\', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BASE = (
    "WITH RECURSIVE d AS (SELECT project, "
    + NAME_SQL.format("fqcn")
    + " AS c, nullif("
    + NAME_SQL.format("extends")
    + """, '') AS e, recorded_at FROM class_decls WHERE fqcn IS NOT NULL),
cur AS (SELECT project, c, e FROM d QUALIFY row_number() OVER (PARTITION BY project, c ORDER BY recorded_at DESC NULLS LAST, e DESC NULLS LAST) = 1),
roots AS (SELECT project, c FROM cur WHERE e IS NULL UNION SELECT project, e FROM cur WHERE e IS NOT NULL AND (project, e) NOT IN (SELECT (project, c) FROM cur)),
tree AS (SELECT project, c, c AS root, 0 AS depth, [c] AS path FROM roots
         UNION ALL SELECT cur.project, cur.c, t.root, t.depth + 1, list_append(t.path, cur.c) FROM tree t JOIN cur ON cur.project = t.project AND cur.e = t.c),
lost AS (SELECT project, c, e FROM cur WHERE e IS NOT NULL AND (project, c) NOT IN (SELECT (project, c) FROM tree)),
reach AS (SELECT project, c, e AS x FROM lost UNION SELECT r.project, r.c, l.e FROM reach r JOIN lost l ON l.project = r.project AND l.c = r.x),
circle AS (SELECT DISTINCT project, c FROM reach WHERE c = x)
"""
)

QUERIES = {"p4_found": p4_found, "p4_paths": p4_paths, "p4_descendants": p4_descendants}
ORACLE = {
    "p4_found": _BASE
    + """SELECT project, c AS fqcn, root, CAST(depth AS BIGINT) AS depth FROM tree WHERE depth > 0
UNION ALL SELECT project, c, '', CASE WHEN (project, c) IN (SELECT (project, c) FROM circle) THEN -1 ELSE -2 END FROM lost""",
    "p4_paths": _BASE
    + """, pairs AS (SELECT project, unnest(path) AS c FROM tree), held AS (SELECT project, c, count(*) - 1 AS n FROM pairs GROUP BY ALL)
SELECT t.project, t.c AS fqcn, array_to_string(t.path, ' > ') AS path, CAST(t.depth AS BIGINT) AS depth, CAST(h.n AS BIGINT) AS descendants
FROM tree t JOIN held h ON h.project = t.project AND h.c = t.c""",
    "p4_descendants": _BASE
    + """, pairs AS (SELECT project, c, depth, unnest(path) AS upper_class, unnest(range(len(path))) AS upper_depth FROM tree)
SELECT project, upper_class AS fqcn, c AS descendant, CAST(depth - upper_depth AS BIGINT) AS below FROM pairs WHERE upper_depth < depth""",
}

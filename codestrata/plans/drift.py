"""Problem 2: metric exports whose fields drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators.drift import alias_table, aliases_of, changes, fields_of, json_object, lifespans, steady
from codestrata.session import cut
from codestrata.tables import table


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "raw_exports").select(F.col("stream").alias("producer"), F.col("export_id").alias("file"), "payload")
    return fields_of(rows, "payload", "metrics", {"item": "name"})


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "raw_exports").groupBy(F.col("stream").alias("producer"), F.col("export_id").alias("file")).agg(F.min("exported_at").alias("at"))


def _uses(entries: DataFrame) -> DataFrame:
    return entries.groupBy("producer", "file", "field", "type").agg(F.count("*").alias("uses"))


def p2_changes(spark: SparkSession, folder: str) -> DataFrame:
    entries = _entries(spark, folder)
    log = changes(_files(spark, folder), _uses(entries), entries)
    return log.select(F.col("producer").alias("stream"), F.col("file").alias("export_id"), "seq", "change", "field", "new_field", "type", "new_type")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_changes(spark, folder).select("export_id", "change", "field", "new_field")


def p2_lifespans(spark: SparkSession, folder: str) -> DataFrame:
    spans = lifespans(_files(spark, folder), _uses(_entries(spark, folder)))
    return spans.select(F.col("producer").alias("stream"), "field", "type", "first_seq", "last_seq", F.col("first_file").alias("first_export"), F.col("last_file").alias("last_export"), "files")


def p2_aliases(spark: SparkSession, folder: str) -> DataFrame:
    """Which steady column each field belongs to, from the renames that the log finds."""
    entries = _entries(spark, folder)
    uses = cut(_uses(entries))
    return alias_table(changes(_files(spark, folder), uses, entries), uses)


def p2_table(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record, with the columns of the alias table; `is_object` is false if its payload is no JSON object."""
    doc = json_object(F.col("payload"))
    known = aliases_of(p2_aliases(spark, folder))
    rows = table(spark, folder, "raw_exports").select("record_id", "export_id", "stream", F.try_variant_get(doc, "$.name", "string").alias("name"), doc.isNotNull().alias("is_object"), "payload")
    keys = ["record_id", "export_id", "stream", "name", "is_object"]
    out = steady(fields_of(rows, "payload", "metrics"), keys, known, rows.select(*keys))
    return out.select(*[c for c in out.columns if c != "is_object"], "is_object")


def p2_totals(spark: SparkSession, folder: str) -> DataFrame:
    """The steady table by column: how many records have a value, and the sum of those that are numbers."""
    wide = p2_table(spark, folder)
    columns = [c for c, t in wide.dtypes if c not in ("record_id", "export_id", "stream") and t in ("bigint", "double")]
    sums = wide.agg(*[F.struct(F.count(c).alias("n"), F.sum(F.col(c).cast("double")).alias("s")).alias(c) for c in columns])
    long = sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), f"{c}.n", f"{c}.s") for c in columns])).alias("x"))
    return long.select("x.column", F.col("x.n").alias("records"), F.round("x.s", 2).alias("total"))


_BASE = r"""
WITH f AS (SELECT stream, export_id, min(exported_at) AS exported FROM raw_exports GROUP BY ALL),
s AS (SELECT *, row_number() OVER w AS seq, lag(export_id) OVER w AS prev FROM f WINDOW w AS (PARTITION BY stream ORDER BY exported, export_id)),
r AS (SELECT stream, export_id, CASE WHEN json_valid(payload) THEN payload::JSON END AS doc FROM raw_exports),
k AS (SELECT stream, export_id, doc->>'name' AS item, doc->'metrics' AS m FROM r WHERE json_type(doc) = 'OBJECT' AND json_type(doc->'metrics') = 'OBJECT'),
u AS (SELECT stream, export_id, item, m, unnest(json_keys(m)) AS field FROM k),
v AS (SELECT stream, export_id, item, field, m->('$."' || field || '"') AS x FROM u),
e AS (SELECT stream, export_id, item, field, x->>'$' AS text,
             CASE json_type(x) WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' WHEN 'VARCHAR' THEN 'string'
                               WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' END AS type FROM v),
n AS (SELECT *, CASE WHEN type IN ('integer', 'number', 'string') THEN TRY_CAST(text AS DOUBLE) END AS value FROM e WHERE type IS NOT NULL),
c AS (SELECT stream, export_id, field, type, count(*) AS uses FROM n GROUP BY ALL),
t AS (SELECT stream, export_id, field, type FROM c QUALIFY row_number() OVER (PARTITION BY stream, export_id, field
        ORDER BY uses DESC, list_position(['integer', 'number', 'string', 'boolean', 'object', 'array'], type)) = 1),
b AS (SELECT s.stream, s.export_id, s.seq, t.field, t.type AS old FROM s JOIN t ON t.export_id = s.prev AND t.stream = s.stream),
a AS (SELECT s.stream, s.export_id, s.seq, t.field, t.type AS new FROM s JOIN t ON t.export_id = s.export_id AND t.stream = s.stream WHERE s.seq > 1),
ab AS (SELECT coalesce(a.stream, b.stream) AS stream, coalesce(a.export_id, b.export_id) AS export_id, coalesce(a.seq, b.seq) AS seq, coalesce(a.field, b.field) AS field, old, new
       FROM a FULL JOIN b ON a.export_id = b.export_id AND a.field = b.field AND a.stream = b.stream),
val AS (SELECT stream, export_id, field, item, max(value) AS value FROM n WHERE item IS NOT NULL GROUP BY ALL),
pairs AS (SELECT g.export_id, g.stream, g.seq, g.field, w.field AS new_field, g.old, w.new, count(*) AS common, count(*) FILTER (WHERE x.value = y.value) AS equal
          FROM ab g JOIN s ON s.export_id = g.export_id AND s.stream = g.stream JOIN ab w ON w.export_id = g.export_id AND w.stream = g.stream
          JOIN val x ON x.export_id = s.prev AND x.field = g.field AND x.stream = g.stream
          JOIN val y ON y.export_id = g.export_id AND y.field = w.field AND y.item = x.item AND y.stream = g.stream
          WHERE g.new IS NULL AND w.old IS NULL GROUP BY ALL),
ren AS (SELECT * FROM pairs WHERE common >= 3 AND equal * 2 > common),
log AS (
  SELECT stream, export_id, seq, 'renamed' AS change, field, new_field, old AS type, new AS new_type FROM ren
  UNION ALL SELECT stream, export_id, seq, 'retyped', field, new_field, old, new FROM ren WHERE old <> new
  UNION ALL SELECT stream, export_id, seq, 'retyped', field, field, old, new FROM ab WHERE old <> new
  UNION ALL SELECT stream, export_id, seq, 'removed', field, '', old, new FROM ab WHERE new IS NULL AND NOT EXISTS (SELECT 1 FROM ren WHERE ren.export_id = ab.export_id AND ren.field = ab.field)
  UNION ALL SELECT stream, export_id, seq, 'added', '', field, old, new FROM ab WHERE old IS NULL AND NOT EXISTS (SELECT 1 FROM ren WHERE ren.export_id = ab.export_id AND ren.new_field = ab.field))
"""

_ALIASES = (
    _BASE
    + r""", ed AS (SELECT field AS x, new_field AS y FROM log WHERE change = 'renamed' UNION SELECT new_field, field FROM log WHERE change = 'renamed' UNION SELECT field, field FROM c),
reach AS (SELECT x, y FROM ed UNION SELECT r.x, e.y FROM reach r JOIN ed e ON e.x = r.y),
comp AS (SELECT x AS field, min(y) AS component FROM reach GROUP BY ALL),
pf AS (SELECT field, component, sum(uses)::BIGINT AS uses FROM c JOIN comp USING (field) GROUP BY ALL),
pt AS (SELECT component, type, sum(uses) AS n FROM c JOIN comp USING (field) GROUP BY component, type QUALIFY row_number() OVER (PARTITION BY component
        ORDER BY sum(uses) DESC, list_position(['integer', 'number', 'string', 'boolean', 'object', 'array'], type)) = 1),
nm AS (SELECT component, field AS named FROM pf QUALIFY row_number() OVER (PARTITION BY component ORDER BY uses DESC, field DESC) = 1),
sn AS (SELECT component, named, lower(regexp_replace(regexp_replace(named, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '[^A-Za-z0-9]+', '_', 'g')) AS snake FROM nm),
cl AS (SELECT component, CASE WHEN row_number() OVER (PARTITION BY snake ORDER BY named) = 1 THEN snake ELSE snake || '__' || row_number() OVER (PARTITION BY snake ORDER BY named) END AS col FROM sn),
al AS (SELECT field, col AS "column", CASE type WHEN 'integer' THEN 'bigint' WHEN 'number' THEN 'double' WHEN 'boolean' THEN 'boolean' ELSE 'string' END AS kind, uses FROM pf JOIN cl USING (component) JOIN pt USING (component))
"""
)
_LIVES = """, y AS (SELECT t.stream, t.field, t.type, s.seq, s.export_id, s.seq - row_number() OVER (PARTITION BY t.stream, t.field, t.type ORDER BY s.seq) AS island FROM t JOIN s ON s.stream = t.stream AND s.export_id = t.export_id)
SELECT stream, field, type, min(seq)::INT AS first_seq, max(seq)::INT AS last_seq, arg_min(export_id, seq) AS first_export, arg_max(export_id, seq) AS last_export, count(*) AS files FROM y GROUP BY stream, field, type, island"""
_TOTALS = """, rr AS (SELECT record_id, CASE WHEN json_valid(payload) THEN payload::JSON END AS doc FROM raw_exports),
rk AS (SELECT record_id, doc->'metrics' AS m FROM rr WHERE json_type(doc) = 'OBJECT' AND json_type(doc->'metrics') = 'OBJECT'),
rv AS (SELECT record_id, field, m->>('$."' || field || '"') AS text FROM (SELECT record_id, m, unnest(json_keys(m)) AS field FROM rk)),
cells AS (SELECT record_id, "column", kind, TRY_CAST(trim(text) AS DOUBLE) AS d, uses, field FROM rv JOIN al USING (field) WHERE kind IN ('bigint', 'double') AND text IS NOT NULL),
whole AS (SELECT record_id, "column", arg_max(CASE WHEN kind = 'bigint' THEN trunc(d) ELSE d END, uses) AS d FROM cells WHERE d IS NOT NULL GROUP BY ALL)
SELECT "column", count(d) AS records, round(sum(d), 2) AS total FROM whole GROUP BY ALL"""

QUERIES = {"p2_found": p2_found, "p2_changes": p2_changes, "p2_lifespans": p2_lifespans, "p2_aliases": p2_aliases, "p2_table": p2_table, "p2_totals": p2_totals}
ORACLE = {
    "p2_found": _BASE + "SELECT export_id, change, field, new_field FROM log",
    "p2_lifespans": _BASE + _LIVES,
    "p2_aliases": _ALIASES.replace("WITH f AS", "WITH RECURSIVE f AS") + "SELECT * FROM al",
    "p2_totals": _ALIASES.replace("WITH f AS", "WITH RECURSIVE f AS") + _TOTALS,
    "p2_changes": _BASE + "SELECT stream, export_id, seq, change, field, new_field, type, new_type FROM log",
}

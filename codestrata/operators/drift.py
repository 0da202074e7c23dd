"""Schemas that drift between files: a catalogue of column lifespans, a log of changes, and one table from all files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codestrata.operators.graph import connected_components
from codestrata.session import cut

#: Types in the order in which a tie of counts is decided.
TYPES = ("integer", "number", "string", "boolean", "object", "array")
#: Up to so many starts and endings of fields (some 100 bytes each) are sent to every task; more are joined by file and field.
SENT_EVENTS = 200_000
#: A steady table has so many fields at most: its columns are part of the plan.
MOST_FIELDS = 5_000
_END = "codestrata: end of payload"


def _wrapped(text: Column) -> Column:
    """`text` and a mark in one array: Spark's parser stops after the first value and would take trailing rubbish; inside
    an array it can't."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]')))


def _is_object(wrapped: Column, text: Column) -> Column:
    """Whether exactly one value was wrapped, and an object: the only JSON value that begins with a brace."""
    alone = F.try_variant_get(wrapped, "$[1]", "string").eqNullSafe(F.lit(_END)) & F.try_variant_get(wrapped, "$[2]", "variant").isNull()
    return alone & F.startswith(F.ltrim(text, F.lit(" \t\n\r")), F.lit("{"))


def json_object(text: Column) -> Column:
    """`text` as a variant if it is exactly one JSON object, else null. Objects that name a key twice count as no JSON."""
    wrapped = _wrapped(text)
    return F.when(_is_object(wrapped, text), F.try_variant_get(wrapped, "$[0]", "variant"))


def variant_type(value: Column) -> Column:
    """One of TYPES for a variant, null for JSON null. 1.0 and 1e3 are numbers, 1 is an integer of any size."""
    kind = F.schema_of_variant(value)
    large = F.abs(F.try_variant_get(value, "$", "double")) >= 9.2e18  # integers beyond a long are kept as decimals
    return (
        F.when(kind == "BIGINT", "integer")
        .when(kind.rlike(r"^DECIMAL\([0-9]+,0\)$") & large, "integer")
        .when(kind.startswith("DECIMAL") | (kind == "DOUBLE") | (kind == "FLOAT"), "number")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "array")
    )


def fields_of(records: DataFrame, payload: str, part: str, names: Mapping[str, str] = {}) -> DataFrame:  # noqa: B006
    """The other columns of `records`, the texts of the payload's own entries `names` (column -> entry), and `field`,
    `type`, `text` and `value` of each non-null entry of the object `part` of its JSON `payload`.

    Payloads that are no JSON object, and parts that are none, give no rows. A dot in a field's name is part of the name.
    `value` is the number that an entry is or, as a string, spells. Each payload is parsed once.
    """
    others = [c for c in records.columns if c != payload]
    parsed = records.select(*others, payload, _wrapped(F.col(payload)).alias("_all"))
    inner = parsed.where(_is_object(F.col("_all"), F.col(payload))).select(
        *others, *[F.try_variant_get("_all", f"$[0].{e}", "string").alias(c) for c, e in names.items()], F.try_variant_get("_all", f"$[0].{part}", "variant").alias("_part")
    )
    others += list(names)
    entries = inner.sparkSession.tvf.variant_explode(F.col("_part").outer()).select(F.col("key").alias("_key"), F.col("value").alias("_value"))
    spread = inner.lateralJoin(entries).where("_key IS NOT NULL")  # an array's entries have no keys
    kind = variant_type(F.col("_value"))
    text = F.when(F.schema_of_variant("_value").rlike("^(OBJECT|ARRAY)"), F.to_json("_value")).otherwise(F.try_variant_get("_value", "$", "string"))
    rows = spread.select(*others, F.col("_key").alias("field"), kind.alias("type"), text.alias("text")).where("type IS NOT NULL")
    number = F.regexp_replace(F.col("text"), r"(?U)^\s+|\s+$", "")
    spelt = number.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$") & F.col("type").isin("integer", "number", "string")
    return rows.withColumn("value", F.when(spelt, number.try_cast("double")))


def lifespans(files: DataFrame, uses: DataFrame) -> DataFrame:
    """The catalogue: per producer, field and type each unbroken run of files that has it.

    `files`: `producer`, `file`, `at`, one row per file; a producer's files follow each other by `at`, then `file`.
    `uses`: `producer`, `file`, `field`, `type`, `uses` (how many non-null values of that type). A field's type in a
    file is the one with most uses, a tie falling to the earlier in TYPES. Returned: `producer`, `field`, `type`,
    `first_seq`, `last_seq`, `first_file`, `last_file`, `files`, `last_of_producer` (the producer's last seq). A file
    without fields still takes its place in the order. Null producers are one producer.

    A footer catalogue has one row per file and field; every window here runs over it, not over records.
    """
    order = Window.partitionBy("producer").orderBy(F.col("at").asc_nulls_first(), F.col("file").asc_nulls_first())
    whole = Window.partitionBy("producer")
    numbered = files.select("producer", "file", F.row_number().over(order).alias("seq"), F.count("*").over(whole).alias("last_of_producer"))
    rank = F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("type"))
    typed = uses.groupBy("producer", "file", "field").agg(F.max_by("type", F.struct("uses", -rank)).alias("type"))
    n = numbered.select(F.col("producer").alias("np"), F.col("file").alias("nf"), "seq", "last_of_producer")
    placed = typed.join(n, F.col("producer").eqNullSafe(F.col("np")) & F.col("file").eqNullSafe(F.col("nf"))).drop("np", "nf")
    runs = Window.partitionBy("producer", "field", "type").orderBy("seq")
    starts = placed.withColumn("starts", F.when(F.col("seq") - F.lag("seq").over(runs) == 1, 0).otherwise(1))
    islands = starts.withColumn("island", F.sum("starts").over(runs))
    return islands.groupBy("producer", "field", "type", "island").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.min_by("file", "seq").alias("first_file"), F.max_by("file", "seq").alias("last_file"),
        F.count("*").alias("files"), F.max("last_of_producer").alias("last_of_producer"),
    ).drop("island")


def changes(files: DataFrame, uses: DataFrame, values: DataFrame, least_common: int = 3) -> DataFrame:
    """The log: `producer`, `file`, `seq`, `change`, `field`, `new_field`, `type`, `new_type` of each change of fields.

    `files` and `uses` as in `lifespans`; `values`: `producer`, `file`, `item`, `field`, `value` double or null, `text`
    (non-null entries). Starts and endings of the lifespans meet at a file: a field that ends and starts there in
    another type is `retyped`; one that only ends is gone, one that only starts is new. A gone and a new field are
    `renamed` if, over the items that have both (the gone one in the file before, the new one in this), at least
    `least_common`, more than half of the values are equal numbers; if its type changes too it is also `retyped`. The
    rest is `removed` (`new_field` '') and `added` (`field` ''). A field that fits several renames is in each of them.
    A producer's first file has no changes. An item repeated in a file counts once, with its largest value.

    Catalogue and log are written once (they are small); only the values of gone and new fields are joined, by file and
    item.
    """
    spans = cut(lifespans(files, uses))
    began = spans.where("first_seq > 1").select("producer", F.col("first_seq").alias("seq"), "field", F.lit(None).cast("string").alias("old"), F.col("type").alias("new"))
    ended = spans.where("last_seq < last_of_producer").select("producer", (F.col("last_seq") + 1).alias("seq"), "field", F.col("type").alias("old"), F.lit(None).cast("string").alias("new"))
    events = began.unionByName(ended).groupBy("producer", "seq", "field").agg(F.max("old").alias("old"), F.max("new").alias("new"))
    order = Window.partitionBy("producer").orderBy(F.col("at").asc_nulls_first(), F.col("file").asc_nulls_first())
    steps = files.select(F.col("producer").alias("sp"), "file", F.row_number().over(order).alias("s"), F.lag("file").over(order).alias("file_before"))
    events = cut(events.join(steps, F.col("producer").eqNullSafe(F.col("sp")) & (F.col("seq") == F.col("s"))).drop("sp", "s"))
    retyped = events.where("old IS NOT NULL AND new IS NOT NULL").withColumn("new_field", F.col("field"))
    gone, new = events.where("new IS NULL"), events.where("old IS NULL")

    # gone fields are looked up in the file before, new ones in the file itself, in one pass over the values
    ends = gone.select("*", F.col("file_before").alias("look"), F.lit("g").alias("mark")).unionByName(new.select("*", F.col("file").alias("look"), F.lit("n").alias("mark")))
    ends = ends.select(F.col("producer").alias("ep"), "look", F.col("field").alias("ef"), "seq", F.col("file").alias("here"), "mark", F.coalesce("old", "new").alias("kind"))
    if ends.limit(SENT_EVENTS + 1).count() <= SENT_EVENTS:
        ends = F.broadcast(ends)
    wanted = values.where("item IS NOT NULL").join(
        ends, F.col("producer").eqNullSafe(F.col("ep")) & (F.col("file") == F.col("look")) & (F.col("field") == F.col("ef"))
    )
    each = cut(wanted.groupBy("producer", "seq", "here", "mark", "field", "kind", "item").agg(F.max("value").alias("value")))

    def side(mark: str) -> DataFrame:
        return each.where(F.col("mark") == mark).select(*[F.col(c).alias(f"{mark}_{n}") for c, n in (("producer", "producer"), ("here", "here"), ("seq", "seq"), ("field", "field"), ("kind", "type"), ("item", "item"), ("value", "value"))])

    before, after = side("g").withColumnRenamed("g_item", "item"), side("n").drop("n_seq")
    met = before.join(after, F.col("g_producer").eqNullSafe(F.col("n_producer")) & (F.col("g_here") == F.col("n_here")) & (F.col("item") == F.col("n_item")))
    pairs = met.groupBy("g_producer", "g_here", "g_seq", "g_field", "n_field", "g_type", "n_type").agg(
        F.count("*").alias("common"), F.count_if(F.col("g_value") == F.col("n_value")).alias("equal")
    )
    renamed = pairs.where((F.col("common") >= least_common) & (F.col("equal") * 2 > F.col("common"))).select(
        F.col("g_producer").alias("producer"), F.col("g_here").alias("file"), F.col("g_seq").alias("seq"), F.col("g_field").alias("field"), F.col("n_field").alias("new_field"), F.col("g_type").alias("old"), F.col("n_type").alias("new")
    )

    def without(rows: DataFrame, name: str) -> DataFrame:
        used = renamed.select(F.col("producer").alias("up"), F.col("seq").alias("us"), F.col(name).alias("uf"))
        return rows.join(used, F.col("producer").eqNullSafe(F.col("up")) & (F.col("seq") == F.col("us")) & (F.col("field") == F.col("uf")), "left_anti")

    def log(rows: DataFrame, change: str, field: Column, new_field: Column) -> DataFrame:
        return rows.select("producer", "file", "seq", F.lit(change).alias("change"), field.alias("field"), new_field.alias("new_field"), F.col("old").alias("type"), F.col("new").alias("new_type"))

    same, none = F.col("field"), F.lit("")
    return (
        log(retyped, "retyped", same, same)
        .unionByName(log(renamed, "renamed", same, F.col("new_field")))
        .unionByName(log(renamed.where("old <> new"), "retyped", same, F.col("new_field")))
        .unionByName(log(without(gone, "field"), "removed", same, none))
        .unionByName(log(without(new, "new_field"), "added", none, same))
    )


def alias_table(log: DataFrame, uses: DataFrame) -> DataFrame:
    """(`field`, `column`, `kind`, `uses`): which steady column each field of a catalogue belongs to, and its Spark type.

    Fields that the log ever calls renames of each other, directly or through others, are one column. It is named after
    the field of them that is used most, in lower case with single underscores (where two columns would have one name, the
    second gets __2), and has the type of most of their uses; objects and arrays are strings.
    """
    counts = cut(uses.groupBy("field", "type").agg(F.sum("uses").alias("n")))
    pairs = log.where("change = 'renamed'").select(F.col("field").alias("a"), F.col("new_field").alias("b"))
    names = counts.select(F.col("field").alias("a"), F.lit(None).cast("string").alias("b"))
    joined = connected_components(pairs.unionByName(names)).select(F.col("node").alias("field"), "component")
    per_field = counts.groupBy("field").agg(F.sum("n").alias("uses")).join(joined, "field")
    rank = F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("type"))
    per_type = counts.join(joined, "field").groupBy("component", "type").agg(F.sum("n").alias("n"))
    kind = F.max_by("type", F.struct("n", -rank)).alias("type")
    columns = per_field.groupBy("component").agg(F.max_by("field", F.struct("uses", "field")).alias("named")).join(per_type.groupBy("component").agg(kind), "component")
    snake = F.lower(F.regexp_replace(F.regexp_replace("named", "([a-z0-9])([A-Z])", "$1_$2"), "[^A-Za-z0-9]+", "_"))
    again = F.row_number().over(Window.partitionBy(snake).orderBy("named"))
    spark_type = F.when(F.col("type") == "integer", "bigint").when(F.col("type") == "number", "double").when(F.col("type") == "boolean", "boolean").otherwise("string")
    columns = columns.select("component", F.when(again == 1, snake).otherwise(F.concat_ws("__", snake, again)).alias("column"), spark_type.alias("kind"))
    return per_field.join(columns, "component").select("field", "column", "kind", "uses")


def aliases_of(table: DataFrame) -> dict[str, tuple[str, str]]:
    """An alias table as `steady` takes it, the fields used most first."""
    rows = table.orderBy(F.desc("uses"), "field").limit(MOST_FIELDS + 1).collect()
    if len(rows) > MOST_FIELDS:
        raise ValueError(f"more than {MOST_FIELDS} fields: choose those that the table should have")
    return {r["field"]: (r["column"], r["kind"]) for r in rows}


def steady(entries: DataFrame, keys: list[str], aliases: Mapping[str, tuple[str, str]], records: DataFrame | None = None) -> DataFrame:
    """One table with steady columns: `keys` (one row each) and the columns that `aliases` maps field names to.

    `entries`: keys, `field`, `text`, `type`. `aliases`: field name -> (column, Spark type); the casts come from it.
    Text that the type can't hold becomes null, with its field name in `not_cast`; several fields of one column that
    meet in a record give the first of them in the order of `aliases`. Fields without alias are left to `other`, a
    map of their texts, so no entry is lost. Keys without entries have a row only if `records` (keys) names them: null
    columns and empty `not_cast` and `other`.
    """
    if records is not None:
        entries = entries.unionByName(records.select(*keys), allowMissingColumns=True)
    columns: dict[str, str] = {c: t for c, t in aliases.values()}
    aggs, failed = [], []
    for column, kind in columns.items():
        names = [f for f, (c, _) in aliases.items() if c == column]
        number = F.trim("text").try_cast("double")
        whole = number.try_cast(kind) if kind in ("bigint", "int") else number if kind == "double" else F.col("text").try_cast(kind)
        parts = [F.max(F.when(F.col("field") == f, whole)) for f in names]
        aggs.append(F.coalesce(*parts).alias(column))
        failed += [F.max(F.when((F.col("field") == f) & whole.isNull(), F.lit(f))) for f in names]
    known = F.col("field").isin(*aliases)
    rest = F.map_from_entries(F.array_distinct(F.collect_list(F.when(~known, F.struct("field", "text")))))
    return entries.groupBy(*keys).agg(*aggs, F.filter(F.array(*failed), lambda x: x.isNotNull()).alias("not_cast"), rest.alias("other"))

from pyspark.sql import functions as F

from codestrata.operators.drift import alias_table, aliases_of, changes, fields_of, json_object, lifespans, steady
from codestrata.plans.drift import p2_table


def _doc(spark, rows):
    df = spark.createDataFrame(rows, "producer string, file long, at int, item string, payload string")
    entries = fields_of(df, "payload", "metrics")
    files = df.groupBy("producer", "file").agg(F.min("at").alias("at"))
    uses = entries.groupBy("producer", "file", "field", "type").agg(F.count("*").alias("uses"))
    return files, uses, entries


def m(**fields):
    import json

    return json.dumps({"metrics": fields})


def test_json_object_is_strict(spark):
    good = ['{"a":1}', ' {"a":{"b":[1,2]}}\n', "{}"]
    bad = ['{"a":1} x', '{"a":1},{"b":2}', "[1]", "1", "", None, '{"a":', 'warning\n{"a":1}', '{"a":1}]', '{"a":1}}', "{'a':1}", '{"a":NaN}', '{"a":1,"a":2}']
    got = spark.createDataFrame([(x,) for x in good + bad], "p string").select("p", json_object(F.col("p")).isNotNull().alias("ok")).collect()
    assert {r.p: r.ok for r in got} == {x: x in good for x in good + bad}


def test_types_and_dotted_names(spark):
    row = '{"metrics":{"i":1,"n":1.0,"e":1e3,"s":"5","b":true,"o":{"x":1},"a":[1],"z":null,"a.b":7,"I":2,"big":123456789012345678901234567890}}'
    _, _, entries = _doc(spark, [("p", 1, 1, "x", row), ("p", 1, 1, "y", "junk"), ("p", 1, 1, "z", '{"metrics":[1]}')])
    got = {r.field: (r.type, r.value) for r in entries.collect()}
    assert got == {"i": ("integer", 1.0), "n": ("number", 1.0), "e": ("number", 1000.0), "s": ("string", 5.0), "b": ("boolean", None), "o": ("object", None), "a": ("array", None), "a.b": ("integer", 7.0), "I": ("integer", 2.0), "big": ("integer", 1.2345678901234568e29)}


def test_changes(spark):
    rows = [("p", 1, 10, n, m(loc=v, old=v, kept=1, gone=1)) for n, v in (("a", 1), ("b", 2), ("c", 3))]
    rows += [("p", 7, 20, n, m(**{"loc": str(v), "new": float(v), "kept": 1, "plus": 9})) for n, v in (("a", 1), ("b", 2), ("c", 3))]
    rows += [("p", 3, 30, "a", "no json")]
    rows += [("p", 4, 40, "a", m(kept=1))]
    got = {(r.file, r.change, r.field, r.new_field) for r in changes(*_doc(spark, rows)).collect()}
    first = {(7, "retyped", "loc", "loc"), (7, "renamed", "old", "new"), (7, "retyped", "old", "new"), (7, "removed", "gone", ""), (7, "added", "", "plus")}
    emptied = {(3, "removed", f, "") for f in ("loc", "new", "kept", "plus")}
    assert got == first | emptied | {(4, "added", "", "kept")}


def test_too_few_common_symbols_is_no_rename(spark):
    rows = [("p", 1, 1, "a", m(old=1)), ("p", 1, 1, "b", m(old=2)), ("p", 2, 2, "a", m(new=1)), ("p", 2, 2, "b", m(new=2))]
    got = {(r.change, r.field, r.new_field) for r in changes(*_doc(spark, rows)).collect()}
    assert got == {("removed", "old", ""), ("added", "", "new")}


def test_lifespans_and_empty(spark):
    rows = [("p", f, f, "a", m(x=1) if f != 3 else m(y=1)) for f in (1, 2, 3, 4)] + [(None, 9, 1, "a", m(x=1))]
    files, uses, _ = _doc(spark, rows)
    got = {(r.producer, r.field, r.first_seq, r.last_seq, r.files) for r in lifespans(files, uses).collect()}
    assert got == {("p", "x", 1, 2, 2), ("p", "x", 4, 4, 1), ("p", "y", 3, 3, 1), (None, "x", 1, 1, 1)}
    assert changes(*_doc(spark, [("p", 1, 1, "a", None)])).count() == 0


def test_steady_table_keeps_what_has_no_alias(spark):
    rows = [("p", 1, 1, "a", m(loc="12", zzz=5)), ("p", 1, 1, "b", m(LOC=[1]))]
    _, _, entries = _doc(spark, rows)
    got = {r.item: r for r in steady(entries, ["item"], {"loc": ("loc", "bigint"), "LOC": ("loc", "bigint")}).collect()}
    assert got["a"].loc == 12 and got["a"].other == {"zzz": "5"} and got["a"].not_cast == []
    assert got["b"].loc is None and got["b"].not_cast == ["LOC"]


def test_table_has_every_record(spark, tmp_path):
    payloads = [m(loc=3), m(), m(loc=None), '{"name": "n"}', "no json", "[1]", None]
    rows = [(n, 1, "s" if n else None, 5, p) for n, p in enumerate(payloads)]
    spark.createDataFrame(rows, "record_id long, export_id long, stream string, exported_at int, payload string").write.parquet(f"{tmp_path}/raw_exports.parquet")
    got = {r.record_id: r for r in p2_table(spark, str(tmp_path)).collect()}
    assert [got[n].loc for n in range(7)] == [3, *[None] * 6]
    assert [got[n].is_object for n in range(7)] == [True] * 4 + [False] * 3
    assert all(got[n].other == {} and got[n].not_cast == [] for n in range(7)) and got[3].name == "n"


def test_aliases_come_from_renames(spark):
    names = ("a", "b", "c")
    rows = [("p", 1, 1, n, m(classLoc=i, size=i / 2, tag="x")) for i, n in enumerate(names)]
    rows += [("p", 2, 2, n, m(**{"class.lines": i, "size": i / 2, "Tag": "y", "flag": True})) for i, n in enumerate(names)]
    rows += [("q", 3, 1, n, m(**{"class.lines": i})) for i, n in enumerate(names)] + [("q", 4, 2, n, m(cl=str(i), tag_2="z")) for i, n in enumerate(names)]
    rows += [("r", 5, 1, "a", m(classLoc=9, tag_2="z"))]
    files, uses, entries = _doc(spark, rows)
    table = alias_table(changes(files, uses, entries), uses)
    got = {r.field: (r.column, r.kind) for r in table.collect()}
    assert got["class.lines"] == got["classLoc"] == got["cl"] == ("class_lines", "bigint")  # the most used name of the three
    assert got["size"] == ("size", "double") and got["flag"] == ("flag", "boolean")
    assert {got["tag"], got["Tag"]} == {("tag", "string"), ("tag__2", "string")} and got["tag_2"] == ("tag_2", "string")
    wide = steady(entries, ["file", "item"], aliases_of(table)).where("item = 'b'").collect()
    assert {r.file: r.class_lines for r in wide} == {1: 1, 2: 1, 3: 1, 4: 1}


def test_an_array_s_entries_are_no_fields(spark):
    _, _, entries = _doc(spark, [("p", 1, 1, "x", '{"metrics":[{"a":1}]}'), ("p", 1, 1, "y", '{"metrics":{}}'), ("p", 1, 1, "z", '{"metrics":{"a":null}}')])
    assert entries.count() == 0

import json

import pytest
from pyspark.sql import functions as F

from codestrata.frontend.php_facts import facts
from codestrata.operators.rules import RULES
from codestrata.sources import baseline, config
from codestrata.sources.files import coverage, discover, edges_of, php_facts
from codestrata.sources.footers import footer_fields

CODE = r"""<?php
namespace App\Core;
use Lib\Base; use Lib\Thing as T;
final class A extends Base implements \Countable {
  private int $x = 0; private $dead; public ?T $t;
  public function __construct(private readonly T $p, bool $flag = false) {}
  public function f(int $a, $b) {
    if ($a && $b || !$a) { return 1; } elseif ($a) { foreach ($b as $c) { $this->x++; if ($c) { continue 2; } } } else { $z = $a ?? $b; }
    switch ($a) { case 1: case 2: break; default: return 2; }
    try { $q = new T($a); } catch (\Exception $e) { }
    $r = match(true) { $a, $b => 1, default => 2 };
    return $this->f($a, fn($y) => $y ? 1 : 2); echo 1;
  }
  private function g() { return $this->x; } // @ignore complexity.cyclomatic -- why
}
function h(string $password) { var_dump($_GET['a']); if ($a == $a) { exit(1); } }
"""


def values(rows, kind, subject):
    return next(r[4] for r in rows if r[0] == kind and r[1] == subject)


def test_callable_measures_by_hand():
    rows = facts(CODE)
    f = values(rows, "callable", "App\\Core\\A::f")
    assert (f["ccn"], f["cognitive"], f["unreachable"], f["unreachableLine"], f["parameters"]) == (13, 17, 1, 12, 2)
    assert values(rows, "callable", "App\\Core\\A::{closure:12}")["ccn"] == 2
    assert values(rows, "callable", "App\\Core::h")["ccn"] == 2 and values(rows, "callable", "App\\Core\\A::__construct")["mi"] == 100


@pytest.mark.parametrize("body,npath", [("", 1), ("a();", 1), ("if ($a) b();", 2), ("if ($a && $b) c(); else d();", 3), ("while ($a) b();", 2), ("if ($a) b(); if ($c) d();", 4), ("switch ($a) { case 1: b(); break; case 2: c(); }", 2), ("try { a(); } catch (E $e) { b(); }", 3), ("return $a ? 1 : 2;", 2), ("for ($i = 0; $i < 3; $i++) { if ($a) b(); }", 3)])
def test_npath(body, npath):
    assert values(facts(f"<?php function f() {{ {body} }}"), "callable", "::f")["npath"] == npath


def test_class_measures():
    c = values(facts(CODE), "class", "App\\Core\\A")
    assert (c["wmc"], c["rfc_own"], c["classLoc"], c["propertyCount"], c["unusedPrivate"], c["constructorParameters"]) == (15, 3, 12, 4, 3, 2)  # a method without statements weighs 1 too
    two = "<?php class C { private $a; private $b; function x() { return $this->a; } function y() { return $this->a; } function z() { return $this->b; } static function s() {} }"
    v = values(facts(two), "class", "C")
    assert v["lcom"] == 2 and v["tcc"] == pytest.approx(1 / 3) and v["lcc"] == pytest.approx(1 / 3)


def test_edges_entries_and_directives():
    rows = facts(CODE)
    edges = {(r[2], r[5]["dep_type"]) for r in rows if r[0] == "edge"}
    assert {("Lib\\Base", "extends"), ("Countable", "implements"), ("Lib\\Thing", "new"), ("Lib\\Thing", "type_hint"), ("Exception", "catch")} <= edges
    assert {r[1] for r in rows if r[0] == "entry"} == {"empty_catch", "debug_code", "superglobals", "identical_subexpression", "exit", "boolean_argument"}
    assert [(r[1], r[3], r[5]["selector"], r[5]["reason"]) for r in rows if r[0] == "directive"] == [("symbol", 14, "complexity.cyclomatic", "why")]


@pytest.mark.parametrize("left, right, same", [("$a->b->c->d->e->f->g", "$a->b->c->d->e->f->g", True), ("$a->b->c->d->e->f->g", "$a->b->c->d->e->f->h", False), ("$a->b->c->d->e->f->g", "$a->b->c->d->e->f->g()", False)])
def test_long_operands(left, right, same):
    rows = facts(f"<?php function f($a) {{ return {left} === {right}; }}")
    assert ("identical_subexpression" in {r[1] for r in rows if r[0] == "entry"}) == same


def test_lines():
    v = values(facts("<?php\n\n// c\n$a = 1; // d\n/* e\n f */\n"), "file", "")
    assert (v["loc"], v["blank"], v["cloc"], v["lloc"]) == (7, 2, 3, 2)


def test_unreadable_files_are_rows(spark, tmp_path):
    (tmp_path / "vendor").mkdir()
    for name, text in (("a.php", CODE), ("b.php", "<?php class {"), ("c.php", "<?php\n/** @generated */"), ("vendor/d.php", CODE)):
        (tmp_path / name).write_text(text)
    files = discover(spark, [str(tmp_path)])
    assert {r.file.rsplit("/")[-1]: r.is_generated for r in files.collect()} == {"a.php": False, "b.php": False, "c.php": True}
    rows = php_facts(files)
    assert {r.file.rsplit("/")[-1]: r.status for r in coverage(files, rows).collect()} == {"a.php": "analysed", "b.php": "failed", "c.php": "generated"}
    assert edges_of(rows).where(F.col("dep_type") == "extends").first().dst_class == "Lib\\Base"
    assert php_facts(files.limit(0)).count() == 0


def test_baseline_file(spark, tmp_path):
    doc = {"version": 13, "entries": {"s": [{"channel": "a#b", "magnitudes": [3, 1]}, {"channel": "c#d", "count": 2}, {"count": 1}, {"channel": "e#f"}]}}
    (tmp_path / "b.json").write_text(json.dumps(doc))
    got = baseline.read_baseline(spark, str(tmp_path / "b.json")).collect()
    assert sorted((r.channel or "", r["count"], r.inert or "") for r in got) == sorted([("a#b", 2, ""), ("c#d", 2, ""), ("", 1, "no channel"), ("e#f", None, "neither magnitudes nor count")], key=lambda x: (x[0], x[1] or 0))
    (tmp_path / "bad.json").write_text("{nope")
    assert baseline.read_baseline(spark, str(tmp_path / "bad.json")).count() == 0


def test_footers(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"a": [1, 2], "b": ["x", "y"], "c": [[1], []]}), tmp_path / "f.parquet")
    paths = spark.createDataFrame([("p", 1, str(tmp_path / "f.parquet")), ("p", 2, str(tmp_path / "none"))], "producer string, file long, path string")
    assert {(r.file, r.field, r.type, r.uses) for r in footer_fields(paths).collect()} == {(1, "a", "integer", 2), (1, "b", "string", 2), (1, "c", "array", 2), (2, "(unreadable)", "string", 0)}


def test_configuration():
    merged = config.merge([("cli", {"failOn": "warning"}), ("defaults", {"failOn": "error", "paths": ["src"]})])
    assert merged == {"failOn": "warning", "paths": ["src"]}
    with pytest.raises(config.ConfigError):
        config.merge([("file", {"nope": 1})])
    assert config.composer_paths('{"autoload": {"psr-4": {"A\\\\": "src/", "B\\\\": ["lib", "x/"]}}}') == (["src", "lib", "x"], ["A", "B"])
    rules = {r.code: r for r in config.configure({"complexity.wmc": {"threshold": 7}, "design.noc": False})}
    assert (rules["complexity.wmc"].warning, rules["complexity.wmc"].error, rules["design.noc"].enabled) == (7, 7, False) and len(rules) == len(RULES)
    with pytest.raises(config.ConfigError):
        config.thresholds({"threshold": 1, "warning": 2})
    assert config.collector_order({"b": {"y"}, "a": {"x"}}, {"b": {"x"}}) == ["a", "b"]


def test_streaming_equals_batch(spark, tmp_path):
    from codestrata.streaming.windows import windowed_counts

    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id) AS ts, concat('t', id % 2) AS event_type FROM range(50)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, windowed_counts(rows).collect()))


def test_everything_is_registered():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 60

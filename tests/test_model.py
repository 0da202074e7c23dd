from pyspark.sql import functions as F

from codestrata.model import canonical, declaration, occurrence_key
from codestrata.operators import graph, policy
from codestrata.sources.config import check_layers


def test_keys(spark):
    rows = [("method", "A\\B", "C", "m", None), ("class", "", "C", None, None), ("function", "A", None, "f", None), ("file", None, None, None, "p.php"), ("namespace", "A", None, None, None), ("project", None, None, None, None), ("other", "A", None, None, None)]
    df = spark.createDataFrame(rows, "t string, n string, c string, m string, f string")
    got = [r[0] for r in df.select(canonical(*[F.col(x) for x in "tncmf"])).collect()]
    assert got == ["callable:A\\B\\C::m", "class:C", "func:A::f", "file:p.php", "ns:A", "project:", None]
    one = spark.range(1)
    assert one.select(declaration(F.lit("class:C"), F.lit("p"), F.lit(2))).first()[0] == "declaration:class:C@p#2"
    a, b = one.select(occurrence_key(x=F.lit(1), y=F.lit("a")), occurrence_key(y=F.lit("a"), x=F.lit(1))).first()
    assert a == b and len(a) == 16


def test_directives_bind_to_the_narrowest_declaration(spark):
    d = spark.createDataFrame([(1, "f", 9), (2, "f", 25), (3, "f", 99), (4, "g", 9)], "directive_id int, file string, line int")
    s = spark.createDataFrame([("f", 5, 30, "class", 1), ("f", 10, 20, "method", 1)], "file string, start int, end int, subject_key string, scope_rank int")
    assert {r.directive_id: r.subject_key for r in policy.bind_directives(d, s).collect()} == {1: "method", 2: "class", 3: None, 4: None}


def test_reachable_and_layers(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), (None, "z")], "src string, dst string")
    got = {tuple(r) for r in graph.reachable(df).select("src", "dst").collect()}
    assert got == {(s, d) for s in "abc" for d in "abc"} | {("x", "y")}
    classes = spark.createDataFrame([("p", "AFoo"), ("p", "BFoo"), ("p", "C")], "project string, class string")
    assigned = graph.assign_layers(classes, [("any", F.col("class").endswith("Foo")), ("late", F.col("class") == "AFoo"), ("none", F.lit(False))])
    assert {r["class"]: r.layer for r in assigned.collect()} == {"AFoo": "any", "BFoo": "any", "C": None}
    assert {r.layer: r.status for r in graph.layer_diagnostics(assigned, ["any", "late", "none"]).collect()} == {"any": "used", "late": "shadowed", "none": "empty"}


def test_policy_problems():
    assert check_layers(["a", "b"], [("a", "b", None)]) == []
    assert check_layers(["a", "b", "a"], [("a", "b", None), ("b", "a", "new"), ("b", "z", None), ("a", "*", None)])[:3] == ["layer a is declared twice", "unknown layer z", "a may use every layer"]

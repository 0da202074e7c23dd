import random

from pyspark.sql import functions as F

from codestrata.llm.topn import top_n

SCHEMA = "g string, s double, name string, id int, rank int, score string"


def run(df, n=3):
    return {(r.g, r["rank"], r.id) for r in top_n(df, [F.col("g")], F.col("s"), [F.col("name"), F.col("id")], [F.col("id")], n).collect()}


def test_against_sorting(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1.0, 2.0, 2.5, -1.0, 0.0, -0.0, None, float("nan"), float("inf")]), rng.choice(["x", "Y", "é", None]), i, 7, "clash") for i in range(300)]
    want = set()
    for g in ("a", "b", None):
        ok = [r for r in rows if r[0] == g and r[1] is not None and r[1] == r[1] and abs(r[1]) != float("inf")]
        ok.sort(key=lambda r: (-r[1], r[2] is not None, (r[2] or "").encode(), r[3]))
        want |= {(g, i + 1, r[3]) for i, r in enumerate(ok[:3])}
    df = spark.createDataFrame(rows, SCHEMA)
    assert run(df) == want and run(df.repartition(7)) == want


def test_the_same_without_the_heap(spark, monkeypatch):
    import codestrata.llm.topn as module

    rng = random.Random(2)
    df = spark.createDataFrame([(rng.choice(["a", None]), rng.choice([1.0, 2.0, None, float("nan")]), rng.choice(["x", "Y", None]), i, 7, "clash") for i in range(200)], SCHEMA)
    heap = run(df, 5)
    monkeypatch.setattr(module, "bounded_heap", lambda item, size: None)
    assert run(df, 5) == heap
    plan = top_n(df, [F.col("g")], F.col("s"), [F.col("name"), F.col("id")], [F.col("id")], 5)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2  # before the shuffle and after it


def test_small_groups_ties_repeats_and_empty(spark):
    df = spark.createDataFrame([("a", 1.0, "x", 1, 0, ""), ("a", 1.0, "x", 1, 0, ""), ("b", None, "y", 2, 0, "")], SCHEMA)
    assert run(df) == {("a", 1, 1), ("a", 2, 1)}
    assert run(df.limit(0)) == set()

import random
from collections import Counter

from pyspark.sql import functions as F

from codestrata.operators.divergence import divergence, except_all_both, finite_number
from codestrata.operators.latest import latest

SCHEMA = "item string, field string, value double, side string, left_value double"


def test_against_brute_force(spark):
    rng = random.Random(2)

    def side():
        keys = {(rng.choice(["a", "b", "c", "d", None]), rng.choice(["x", "y", None])) for _ in range(7)}
        return {k: rng.choice([1.0, 1.0000001, 2.0, None, float("nan"), float("inf")]) for k in keys}

    for _ in range(4):
        left, right = side(), side()
        make = lambda d: spark.createDataFrame([(*k, v, "extra", 9.0) for k, v in d.items()], SCHEMA)
        clean = lambda v: v if v is not None and v == v and abs(v) != float("inf") else None
        want = set()
        items = {k[0] for k in left}, {k[0] for k in right}
        want |= {("left_only", i, None) for i in items[0] - items[1]} | {("right_only", i, None) for i in items[1] - items[0]}
        for k in set(left) | set(right):
            a, b = clean(left.get(k)), clean(right.get(k))
            if k[0] in items[0] & items[1] and ((a is None) != (b is None) or a is not None and abs(a - b) > 1e-6):
                want.add(("differs", *k))
        got = [(r.kind, r.item, r.field) for r in divergence(make(left), make(right), 1e-6).collect()]
        assert set(got) == want and len(got) == len(want)


def test_except_all_counts_repeats_and_nulls(spark):
    a = [("x",)] * 3 + [(None,)] * 2 + [("y",)]
    b = [("x",)] + [(None,)] * 3
    got = except_all_both(spark.createDataFrame(a, "c string"), spark.createDataFrame(b, "c string"), ["c"]).collect()
    ca, cb = Counter(a), Counter(b)
    want = Counter({(k[0], "left"): n for k, n in (ca - cb).items()}) + Counter({(k[0], "right"): n for k, n in (cb - ca).items()})
    assert Counter((r.c, r.side) for r in got) == want


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([("a", "x", 1.0, "", 0.0)], SCHEMA)
    assert divergence(empty, empty).count() == 0
    assert [tuple(r)[:2] for r in divergence(one, empty).collect()] == [("left_only", "a")]


def test_finite_number(spark):
    texts = {" 2 ": 2.0, "+3": 3.0, "1.000000e+00": 1.0, ".5": 0.5, "5.": 5.0, "n/a": None, "": None, " ": None, "-": None, "NaN": None, "INF": None, "1e999": None, "1d": None, "0x1p3": None, "1 2": None, " 7\t": 7.0, None: None}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", finite_number(F.col("t")).alias("v"))
    assert {r.t: r.v for r in df.collect()} == texts


def test_latest_takes_the_last_and_breaks_ties(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("k", 2, "c"), ("n", None, "d"), (None, 5, "e")], "k string, t int, v string")
    assert {(r.k, r.v) for r in latest(df, ["k"], ["t"], ["v"]).collect()} == {("k", "c"), ("n", "d"), (None, "e")}
    assert latest(df.limit(0), ["k"], ["t"], ["v"]).count() == 0

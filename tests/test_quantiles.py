import random

import numpy as np
import pytest

from codestrata.operators.quantiles import percentiles


@pytest.mark.parametrize("few,buckets,held", [(100_000, 1024, 100_000), (5, 4, 0), (5, 4, 199), (100_000, 1024, 0)])
def test_exact_whatever_the_distribution(spark, few, buckets, held):
    rng = random.Random(6)
    rows = [("a", rng.gauss(0, 1)) for _ in range(300)] + [("b", float(rng.randrange(3))) for _ in range(200)] + [(None, 2.0 ** rng.randrange(40)) for _ in range(150)] + [("one", 7.0), ("none", None), ("a", float("nan"))]
    shares = [0.05, 0.5, 0.95]
    got = {(r.k, r.share): r.percentile for r in percentiles(spark.createDataFrame(rows, "k string, value double"), ["k"], "value", shares, few, buckets, held).collect()}
    want = {}
    for k in ("a", "b", None, "one"):
        values = [v for g, v in rows if g == k and v is not None and v == v]
        want |= {(k, s): float(np.percentile(values, s * 100)) for s in shares}
    assert got == pytest.approx(want)


def test_empty(spark):
    assert percentiles(spark.createDataFrame([], "k string, value double"), ["k"], "value", [0.5]).count() == 0


def test_a_roll_up_is_the_same_for_large_groups(spark, monkeypatch):
    import codestrata.operators.quantiles as module
    from codestrata.operators.rollup import roll

    rng = random.Random(8)
    df = spark.createDataFrame([(rng.choice(["a", "b", None]), rng.choice([None, 1, 2, 3, 50]), rng.gauss(0, 1)) for _ in range(400)] + [("empty", None, None)], "k string, x int, y double")
    plain = {r.k: r.asDict() for r in roll(df, ["k"], ["x", "y"]).collect()}
    monkeypatch.setattr(module.percentiles, "__defaults__", (5, 4, 20))
    large = {r.k: r.asDict() for r in roll(df, ["k"], ["x", "y"], large=True).collect()}
    assert large.keys() == plain.keys() and list(large["a"]) == list(plain["a"])
    for k, row in plain.items():
        assert large[k] == pytest.approx(row) if k != "empty" else large[k] == row

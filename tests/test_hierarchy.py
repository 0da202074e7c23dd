import random

from codestrata.operators.hierarchy import climb, decompose, on_cycles


def brute(rows):
    parent = {(s, i): (s, p) for s, i, p in rows if i is not None and p is not None}
    nodes = {(s, i) for s, i, _ in rows if i is not None} | set(parent.values())
    out = {}
    for n in nodes:
        way, x = [n], n
        while x in parent and parent[x] not in way:
            x = parent[x]
            way.append(x)
        if x in parent:
            out[n] = ("on" if parent[way[-1]] == n else "into", None, None)
        else:
            out[n] = (None, way[-1][1], len(way) - 1)
    return parent, out


def check(spark, rows):
    forest = decompose(spark.createDataFrame(rows, "scope string, id string, parent string"))
    parent, want = brute(rows)
    nodes = forest.nodes.collect()
    assert {(r.scope, r.id): (r.cycle, r.root, r.depth) for r in nodes} == want
    below = {}
    for n, (cycle, _, _) in want.items():
        x = n
        while cycle is None and x in parent:
            x = parent[x]
            below.setdefault(x, set()).add(n[1])
    got = {}
    for r in forest.descendants().collect():
        got.setdefault((r.scope, r.id), set()).add(r.descendant)
    assert got == below
    assert {(r.scope, r.id): r["size"] for r in nodes if r.cycle is None} == {n: len(below.get(n, ())) + 1 for n, w in want.items() if w[0] is None}
    for r in forest.paths().collect():
        way, x = [r.id], (r.scope, r.id)
        while x in parent:
            x = parent[x]
            way.insert(0, x[1])
        assert r.path == way


def test_random_forests_with_cycles(spark):
    rng = random.Random(5)
    rows = []
    for scope in ("a", "b", None):
        ids = [f"n{i}" for i in range(60)]
        for i, x in enumerate(ids):
            p = rng.choice([None, f"n{rng.randrange(60)}", f"n{max(0, i - 1)}", "outside"])
            rows.append((scope, x, p))
    check(spark, rows)


def test_chain_star_self_link_and_null_ids(spark):
    rows = [("s", f"c{i:02}", f"c{i - 1:02}" if i else None) for i in range(40)]
    rows += [("s", f"leaf{i}", "c05") for i in range(30)] + [("s", "me", "me"), ("s", "child", "me"), ("s", None, "c01"), ("s", "x", "y"), ("s", "y", "z"), ("s", "z", "x")]
    check(spark, rows)


def test_lone_nodes_and_names_that_share_a_hash(spark, monkeypatch):
    import codestrata.operators.hierarchy as module

    check(spark, [("s", "alone", None), ("s", "a", "only mentioned"), (None, "x", None), ("t", "alone", None), ("t", "b", "alone")])
    real, calls = module.F.xxhash64, []

    def first_seed_collides(*columns):
        calls.append(1)
        return module.F.lit(7).cast("long") if len(calls) <= 3 else real(*columns)

    monkeypatch.setattr(module.F, "xxhash64", first_seed_collides)
    forest = decompose(spark.createDataFrame([("s", "a", None), ("s", "b", "a"), ("s", "c", "a")], "scope string, id string, parent string"))
    assert {(r.id, r.root, r.depth) for r in forest.nodes.collect()} == {("a", "a", 0), ("b", "a", 1), ("c", "a", 1)} and len(calls) > 3


def test_empty(spark):
    forest = decompose(spark.createDataFrame([], "scope string, id string, parent string, root string, size int"))
    assert forest.nodes.count() == 0 and forest.paths().count() == 0 and forest.descendants().count() == 0


def test_climb_separates_cycles(spark):
    reached, lost = climb(spark.createDataFrame([(1, None, 1), (2, 1, 5), (3, 4, 1), (4, 3, 1), (5, 4, 1)], "v long, p long, weight long"), sizes=True)
    assert {(r.v, r.top, r.steps, r["size"]) for r in reached.collect()} == {(1, 1, 0, 6), (2, 1, 1, 5)}
    assert {r.v for r in on_cycles(lost).collect()} == {3, 4}

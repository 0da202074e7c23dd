import random

import pytest

from codestrata.llm.mix import mix, plan, shares

DOCS = "doc_id long, source string, kind string, tokens long, epoch string, rest string"
TARGETS = "source string, target_share double, max_repeats int"


def poured(nodes, budget):
    """Budgets of [(weight, capacity)] by handing out what is left again and again."""
    got, open_ = [0.0] * len(nodes), set(range(len(nodes)))
    while open_ and budget > 1e-9:
        whole = sum(nodes[i][0] for i in open_)
        parts = {i: min(budget * nodes[i][0] / whole, nodes[i][1] - got[i]) for i in open_}
        budget -= sum(parts.values())
        for i, part in parts.items():
            got[i] += part
        open_ = {i for i in open_ if nodes[i][1] - got[i] > 1e-9}
    return got


def brute(leaves, targets, total):
    """Budgets of [(labels, held)], the target at the last label, level by level."""
    held = {s: sum(h for labels, h in leaves if labels[-1] == s) for s in targets}
    node = {labels: (targets[labels[-1]][0] * h / held[labels[-1]], h * targets[labels[-1]][1]) for labels, h in leaves}
    total = min(total if total is not None else sum(h for _, h in leaves), sum(c for _, c in node.values()))

    def down(prefix, budget):
        if prefix in node:
            return {prefix: budget}
        kids = sorted({labels[: len(prefix) + 1] for labels in node if labels[: len(prefix)] == prefix}, key=repr)
        sums = [tuple(sum(v[i] for labels, v in node.items() if labels[: len(k)] == k) for i in (0, 1)) for k in kids]
        return {leaf: b for k, part in zip(kids, poured(sums, budget)) for leaf, b in down(k, part).items()}

    return down((), float(total))


@pytest.mark.parametrize("seed", range(6))
def test_budgets_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    targets = {s: (rng.random(), rng.choice([1, 2, 5])) for s in "abcde"}
    leaves = [((d, lang, s), rng.choice([1, 5, 50, 500])) for d in ("x", "y", None) for lang in ("en", None) for s in targets if rng.random() < 0.7]
    held = spark.createDataFrame([(*labels, h) for labels, h in leaves], "domain string, lang string, source string, held long")
    wanted = spark.createDataFrame([(s, *v) for s, v in targets.items()], TARGETS)
    for total in (None, 30.0, 10.0**6):
        got = {(r.domain, r.lang, r.source): r.budget for r in plan(held, wanted, ["domain", "lang", "source"], total).collect()}
        assert got == pytest.approx(brute(leaves, targets, total))


def test_shortage_stays_in_the_family_until_the_family_is_exhausted(spark):
    held = spark.createDataFrame([("code", "a", 10), ("code", "b", 100), ("text", "a", 100), ("text", "c", 1000)], "kind string, source string, held long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.1, 1), ("c", 0.4, 2)], TARGETS)
    of = lambda total: {(r.kind, r.source): round(r.budget, 6) for r in plan(held, targets, ["kind", "source"], total).collect()}
    got = of(400.0)  # code weighs 0.5 / 11 + 0.1, text 0.5 / 1.1 + 0.4: a leaf runs short in each, and its sibling takes it
    assert got["code", "a"] == 10 and got["code", "a"] + got["code", "b"] == pytest.approx(400 * (0.5 / 11 + 0.1))
    assert got["text", "a"] == 100 and got["text", "c"] == pytest.approx(400 * (0.5 / 1.1 + 0.4) - 100)
    got = of(1500.0)  # now all of code runs short, and text takes it
    assert got == {("code", "a"): 10, ("code", "b"): 100, ("text", "a"): 100, ("text", "c"): 1290}


@pytest.mark.parametrize("total", [None, 900.0, 10.0**9])
def test_mix(spark, total):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None, "untargeted"]), rng.choice(["k", "l", None]), rng.choice([0, 3, 7, 20, None]), "clash", "clash") for i in range(900)]
    docs = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 2), ("absent", 0.1, 5)], TARGETS)
    used = mix(docs, targets, ["kind", "source"], total=total, seed=7).collect()
    caps = {"a": 1, "b": 3, "c": 2}
    times = {}
    for r in used:
        assert r.source in caps and r.epoch <= caps[r.source]
        times.setdefault(r.doc_id, []).append(r.epoch)
    assert all(sorted(e) == list(range(1, len(e) + 1)) or len(set(e)) == len(e) for e in times.values())
    sizes = {s: sum(r.tokens for r in used if r.source == s) for s in caps}
    held = {s: sum(r[3] or 0 for r in rows if r[1] == s) for s in caps}
    if total is None:  # everything that is held: a runs short, the others take over
        assert sum(sizes.values()) == pytest.approx(sum(held.values()), rel=0.02) and sizes["a"] <= held["a"]
    if total == 900:
        for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.1)):
            assert sizes[s] / 900 == pytest.approx(share / 0.9, abs=0.03)
    if total == 10**9:
        assert sizes == {s: held[s] * caps[s] for s in caps}
    table = {r.source: r for r in shares(mix(docs, targets, ["kind", "source"], total=total, seed=7), docs, targets, "source").collect()}
    assert table["absent"].outcome == "absent" and table["absent"].used_tokens == 0
    assert total != 10**9 or all(table[s].outcome == "exhausted" for s in caps)
    assert {s: table[s].used_tokens for s in caps} == sizes


def test_levels_of_any_name(spark):
    docs = spark.createDataFrame([(i, "x" if i % 2 else None, "ab"[i % 3 > 0], 5) for i in range(60)], "id long, level string, bucket string, size long")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1), (None, 0.2, 1), ("a", None, None)], "bucket string, target_share double, max_repeats int")
    rows = mix(docs, targets, ["level", "bucket"], "id", "size", total=200, seed=1)
    assert rows.columns == ["id", "level", "bucket", "epoch", "size"] and abs(sum(r["size"] for r in rows.collect()) - 200) <= 10


def test_same_whatever_the_order_and_empty(spark):
    docs = spark.createDataFrame([(i, "a", "k", i % 9 + 1, "", "") for i in range(200)], DOCS)
    targets = spark.createDataFrame([("a", 1.0, 2)], TARGETS)
    runs = [sorted((r.doc_id, r.epoch) for r in mix(d, targets, ["kind", "source"], total=500, seed=3).collect()) for d in (docs, docs.repartition(6))]
    assert runs[0] == runs[1] and abs(sum(i % 9 + 1 for i, _ in runs[0]) - 500) <= 5
    assert mix(docs.limit(0), targets, ["kind", "source"]).count() == 0 and mix(docs, targets.limit(0), ["kind", "source"]).count() == 0

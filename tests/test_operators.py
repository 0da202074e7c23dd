import random

import pytest
from pyspark.sql import functions as F

from codestrata.functions import matching, text
from codestrata.operators import clones, formula, graph, policy, rollup, rules
from codestrata.plans import texts
from codestrata.sinks import formats


def test_seven_aggregates_interpolate(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 4.0, 10.0, None)], "v double")
    r = rollup.roll(df, [], ["v"]).first()
    assert (r.v_sum, r.v_avg, r.v_max, r.v_min, r.v_count) == (17.0, 4.25, 10.0, 1.0, 4)
    assert r.v_p95 == pytest.approx(9.1) and r.v_p5 == pytest.approx(1.15)


def test_ancestors_carry_raw_values(spark):
    df = spark.createDataFrame([("A\\B", 1.0), ("A\\B", 5.0), ("A\\C\\D", 3.0), ("A", 10.0), ("", 7.0), (None, 7.0)], "ns string, v double")
    got = {r.ns: (r.v_sum, r.v_max, r.v_p95) for r in rollup.roll_up_paths(df, "ns", ["v"]).collect()}
    assert got["A"] == (19.0, 10.0, pytest.approx(9.25)) and set(got) == {"A", "A\\B", "A\\C", "A\\C\\D"}
    assert {r.ns for r in rollup.leaves(df.where("ns IS NOT NULL"), "ns").collect()} == {"A\\B", "A\\C\\D"}


def test_definitions_add_counts(spark):
    facts = spark.createDataFrame([("c", "callable", "ccn", 3.0), ("c", "callable", "ccn", 5.0), ("c", "callable", "other", 1.0)], "k string, level string, metric string, value double")
    defs = spark.createDataFrame([("ccn", "callable", "class", "avg")], "metric string, collected_at string, target_level string, strategy string")
    assert {(r.metric, r.value) for r in rollup.roll_by_definition(facts, defs, ["k"]).collect()} == {("ccn.avg", 4.0), ("ccn.count", 2.0)}


EDGE = "project string, src_class string, src_ns string, dst_class string, dst_ns string, dep_type string"


def edges(spark, pairs, kind="new"):
    return spark.createDataFrame([("p", a, "", b, "", kind) for a, b in pairs], EDGE)


@pytest.mark.parametrize("local", [0, 10**6])
def test_class_rank_shapes(spark, local):
    nodes = spark.createDataFrame([("p", c) for c in "abcd"], "project string, class string")
    rank = lambda pairs, n=nodes: {r["class"]: r["rank"] for r in graph.class_rank(edges(spark, pairs), n, local_edges=local).collect()}
    star = rank([("a", "d"), ("b", "d"), ("c", "d"), ("d", "d"), ("a", "outside")])
    assert sum(star.values()) == pytest.approx(1) and max(star, key=star.get) == "d"
    assert rank([]) == pytest.approx({c: 0.25 for c in "abcd"})
    assert rank([], nodes.where("class = 'a'")) == {"a": 1.0} and rank([], nodes.limit(0)) == {}


@pytest.mark.parametrize("local", [0, 10**6])
def test_cycles(spark, local):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("x", "x"), ("b", "a"), (None, "a")]
    df = spark.createDataFrame(pairs, "src string, dst string")
    members = graph.strongly_connected(df, local_edges=local)
    assert {(r.node, r.component) for r in members.collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")}
    got = {r.component: (r.size, r.members, r.cycle) for r in graph.shortest_cycles(df.where("src IS NOT NULL"), members, local_edges=local).collect()}
    assert got == {"a": (3, ["a", "b", "c"], ["a", "b", "a"]), "d": (2, ["d", "e"], ["d", "e", "d"])}
    assert graph.strongly_connected(df.limit(0), local_edges=local).count() == 0


def test_connected_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    label = {x: x for p in pairs for x in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = graph.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == label


def test_coupling_counts(spark):
    r = {x["class"]: x for x in graph.class_coupling(edges(spark, [("A\\x", "B\\y"), ("A\\x", "B\\y"), ("A\\x", "A\\z"), ("B\\y", "A\\x"), ("A\\x", "A\\x")])).collect()}
    assert (r["A\\x"].ce, r["A\\x"].ca, r["A\\x"].cbo, r["A\\x"].ce_packages, round(r["A\\x"].instability, 4)) == (2, 1, 2, 1, 0.6667)


def test_rules_thresholds_and_overrides(spark):
    rows = spark.createDataFrame([("a", "f", 1, 10), ("b", "f", 2, 25), ("c", "f", 3, 9), ("d", "f", None, None)], "subject_key string, file string, line int, ccn int")
    rule = rules.RULES[0]
    assert {(r.subject_key, r.severity, r.threshold) for r in rules.threshold_findings(rows, rule).collect()} == {("a", "warning", 10.0), ("b", "error", 20.0)}
    over = spark.createDataFrame([("a", "complexity", 1, 5, 0, 3.0, 5.0), ("a", "complexity.cyclomatic", 2, 9, 1, 50.0, None), ("c", "*", 1, 1, 0, 5.0, 9.0)], "subject_key string, selector string, scope_rank int, span int, seq int, warning double, error double")
    assert {(r.subject_key, r.severity) for r in rules.threshold_findings(rows, rule, over).collect()} == {("b", "error"), ("c", "error")}


def test_overshoot(spark):
    df = spark.createDataFrame([(30, 20.0, 10.0, "higher"), (30, 100.0, 10.0, "higher"), (30, 5.0, 10.0, "higher"), (60, 10.0, 40.0, "lower"), (30, 0.0, 10.0, "lower")], "b int, v double, t double, w string")
    got = [r[0] for r in df.select(rules.overshoot_minutes(F.col("b"), F.col("v"), F.col("t"), F.col("w"))).collect()]
    assert got == [30, 69, 30, 83, 30]


def test_ceiling_is_multiset_dominance(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(200):
        rows.append(([float(rng.randrange(5)) for _ in range(rng.randrange(1, 5))], [float(rng.randrange(5)) for _ in range(rng.randrange(1, 5))], rng.choice(["higher", "lower"])))
    df = spark.createDataFrame(rows, "c array<double>, s array<double>, w string")
    for r in df.select("*", policy.within(F.col("c"), F.col("s"), F.col("w")).alias("ok")).collect():
        bad = (lambda x, y: x >= y) if r.w == "higher" else (lambda x, y: x <= y)
        want = all(sum(bad(x, level) for x in r.c) <= sum(bad(x, level) for x in r.s) for level in r.c)
        assert r.ok == want, r


def test_own_baseline_is_within(spark):
    f = spark.createDataFrame([("ch", "s", 1.0), ("ch", "s", 2.0), ("ch", "t", float("nan")), (None, "u", 1.0)], "channel string, subject_key string, value double")
    channels = spark.createDataFrame([("ch", "magnitude", "higher")], "channel string, shape string, worse string")
    assert [r.verdict for r in policy.judge(f, policy.generate_baseline(f), channels).collect()] == ["within"]
    assert sorted(r.reason for r in policy.rejected_findings(f).collect()) == ["not finite", "undeclared"]


def test_formulas(spark):
    df = spark.createDataFrame([(1.0, 0.0, None), (4.0, 2.0, 3.0)], "a double, b double, c__d double")
    run = lambda f: [r[0] for r in df.select(formula.compile_formula(f, set(df.columns))).collect()]
    assert run("a / b") == [None, 2.0]
    assert run("(c__d ?? 10) + 2 ** 3 * -1") == [2.0, -5.0]
    assert run("max(a, c__d)") == [None, 4.0] and run("clamp(a * 100, 0, 150)") == [100.0, 150.0]
    assert run("a in [1, 2] ? 1 : (b > 1 && !(a < 0) ? 2 : 3)") == [1.0, 2.0]
    assert run("missing ?? 5") == [5.0, 5.0] and run("sqrt(0 - a)") == [None, None]
    assert formula.unknown_variables({"computed.x": "nope + (maybe ?? 1) + a"}, {"a"}) == {"computed.x": ["nope"]}
    assert formula.order({"computed.b": "computed__a", "computed.a": "1"}) == ["computed.a", "computed.b"]
    with pytest.raises(formula.FormulaError):
        formula.parse("a +")


def test_matching(spark):
    df = spark.createDataFrame([("src/a/b.php",), ("src/ab.php",), ("src/a",)], "p string")
    assert [r[0] for r in df.select(matching.path_matches(F.col("p"), ["src/a"])).collect()] == [True, False, True]
    ns = spark.createDataFrame([("App\\Core",), ("App\\CoreX",), ("App",), (None,)], "n string")
    assert [r[0] for r in ns.select(matching.namespace_matches(F.col("n"), ["App\\Core", ""])).collect()] == [True, False, False, False]
    got = [r[0] for r in ns.select(matching.capture(F.col("n"), "App\\{m}")).collect()]
    assert got == [{"m": "Core"}, {"m": "CoreX"}, None, None]


def test_sensitive_names(spark):
    names = {"password": True, "userPassword": True, "passwordHash": False, "isPassword": False, "apiKey": True, "key": False, "accessToken": True, "token": False, "XMLSecret": True, "resetToken": False, "": False, None: False}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", text.is_sensitive_name(F.col("n")).alias("s")).collect()
    assert {r.n: r.s for r in got} == names


def test_clones(spark):
    a, b = [f"t{i}" for i in range(20)], [f"u{i}" for i in range(10)]
    files = spark.createDataFrame([("f1", a), ("f2", b + a[5:15] + b), ("f3", []), ("f4", None)], "file string, tokens array<string>")
    got = {(r.a_file, r.a_pos, r.b_file, r.b_pos, r.tokens) for r in clones.clone_pairs(files, 8).collect()}
    assert got == {("f1", 5, "f2", 10, 10), ("f2", 0, "f2", 20, 10)}
    blocks = clones.clone_blocks(clones.clone_pairs(files, 8), files)
    assert sorted(len(r.places) for r in blocks.collect()) == [2, 2]
    assert clones.greedy_cover(blocks.withColumn("group", F.lit(1))).count() == 2


def test_clones_have_no_most_frequent_window(spark):
    body = [f"t{i}" for i in range(12)]
    files = spark.createDataFrame([(f"f{n:03}", [f"x{n}", *body, f"y{n}"]) for n in range(102)], "file string, tokens array<string>")
    pairs = clones.clone_pairs(files, 10)
    assert pairs.count() == 102 * 101 // 2 and {r[0:2] for r in pairs.select("a_pos", "tokens").distinct().collect()} == {(1, 12)}
    assert [len(r.places) for r in clones.clone_blocks(pairs, files).collect()] == [102]


def test_a_frequent_window_does_not_break_a_clone(spark):
    body, common = [f"t{i}" for i in range(40)], [f"t{i}" for i in range(15, 25)]
    rows = [("a", ["p", *body, "q"]), ("b", ["r", *body, "s"]), *[(f"c{n:03}", [f"x{n}", *common, f"y{n}"]) for n in range(100)]]
    files = spark.createDataFrame(rows, "file string, tokens array<string>")
    got = clones.clone_pairs(files, 10)
    assert [tuple(r) for r in got.where("a_file = 'a' AND b_file = 'b'").collect()] == [("a", 1, "b", 1, 40)]
    assert got.where("a_file IN ('a', 'b') AND b_file LIKE 'c%' AND tokens = 10").count() == 200


def test_tokens_leave_comments_out(spark):
    text = "<?php $a = \"x // y\"; // one\n# two\n#[Attr]\n/* three\n ' */ $b = 'it''s' . 1.5; /* open"
    rows = spark.createDataFrame([(text,)], "t string").select(clones.normal_tokens(F.col("t")).alias("w")).first()
    assert rows.w == ["<", "?", "php", "$_", "=", "'_'", ";", "#[", "Attr", "]", "$_", "=", "'_'", "'_'", ".", "0", ";"]


def test_tokens_of_very_long_pieces(spark):
    long = 300_000
    for text, want in (("/*" + "x*" * long + "*/ a", ["a"]), ('"' + "\\\\" * long + '" b', ["'_'", "b"]), ("'" + "\\'x" * long + "'", ["'_'"]), ("/*" + "y\n" * long, []), ("z" * long, ["z" * long])):
        row = spark.createDataFrame([(text,)], "t string").select(clones.normal_tokens(F.col("t")).alias("w")).first()
        assert row.w == want


def test_clones_as_by_brute_force(spark):
    dice = random.Random(5)
    texts = {f"f{n}": [dice.choice("ab") for _ in range(dice.randint(0, 40))] + ["a", "b"] * dice.randint(0, 8) for n in range(8)}
    want = set()
    for f, s in texts.items():
        for g, t in texts.items():
            for i in range(len(s)):
                for j in range(len(t)):
                    if (f, i) < (g, j) and not (i and j and s[i - 1] == t[j - 1]):
                        n = next((x for x in range(min(len(s) - i, len(t) - j)) if s[i + x] != t[j + x]), min(len(s) - i, len(t) - j))
                        if n >= 6 and (f != g or j - i >= n):
                            want.add((f, i, g, j, n))
    files = spark.createDataFrame(list(texts.items()), "file string, tokens array<string>")
    got = [tuple(r) for r in clones.clone_pairs(files, 6).collect()]
    assert len(got) == len(want) > 100 and set(got) == want


def test_clones_of_files_without_language_or_path(spark, tmp_path):
    text = "<?php " + " ".join(f"f{i}();" for i in range(20))
    rows = [(1, "php", "a.php"), (2, None, "src\\B.PHP"), (3, "php", None), (4, None, "c.py"), (5, "python", None), (6, None, None), (7, None, "copy.php")]
    texts_of = lambda n: f"<?php g{n % 6}(); {text[6:]} // comment {n}"
    spark.createDataFrame([(*r, "source_code", texts_of(r[0])) for r in rows], "doc_id long, lang string, path string, doc_kind string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = texts.clone_pairs(spark, str(tmp_path))
    assert {(r.a_file, r.b_file) for r in got.collect()} == {(1, 2), (1, 3), (2, 3)}
    assert [r.places for r in texts.clone_blocks(spark, str(tmp_path)).collect()] == [3]
    assert {tuple(r) for r in texts.clone_copies(spark, str(tmp_path)).collect()} == {(1, 1, 2), (7, 1, 2)}  # but for comments


def test_class_rank_stops_by_project_either_way(spark):
    rows = [("quick", "a", "b"), ("quick", "b", "a"), (None, "a", "b"), *[("slow", f"n{i}", f"n{i + 1}") for i in range(6)], ("slow", "n6", "n0"), ("slow", "n3", "n0"), ("mid", "x", "y"), ("mid", "y", "x"), ("mid", "z", "x")]
    edges = spark.createDataFrame(rows, "project string, src_class string, dst_class string")
    classes = edges.selectExpr("project", "src_class AS class").union(edges.selectExpr("project", "dst_class")).distinct()
    ends = [{(r["project"], r["class"]): r["rank"] for r in graph.class_rank(edges, classes, tolerance=0.2, rounds=8, local_edges=n).collect()} for n in (100, 0)]
    assert len(ends[0]) == 14 and ends[0].keys() == ends[1].keys()
    assert all(abs(v - ends[1][k]) < 1e-12 for k, v in ends[0].items())


def test_suppression_and_projection(spark):
    f = spark.createDataFrame([(1, "a#a.x", "s1", "f", 5, "error", "N"), (2, "b#b", "s2", "f", 9, "warning", "N"), (3, "c#c", "s3", "g/h", 1, "warning", "N\\M"), (4, "cfg#cfg", "p", None, None, "error", None)], "finding_id int, channel string, subject_key string, file string, line int, severity string, namespace string")
    d = spark.createDataFrame([(10, "symbol", "s1", None, None, "a"), (11, "next-line", None, "f", 8, "*"), (12, "file", None, "zzz", None, "*")], "directive_id int, kind string, subject_key string, file string, line int, selector string")
    assert {r.finding_id: r.suppressed_by for r in policy.suppressed(f, d).collect()} == {1: 10, 2: 11, 3: None, 4: None}
    assert [r.directive_id for r in policy.unused_directives(f, d).collect()] == [12]
    got = {r.finding_id: r.removed_by for r in policy.project_findings(f.withColumn("value", F.lit(1.0)), d, ["g"], config_channels=["cfg#cfg"]).collect()}
    assert got == {1: "suppression", 2: "suppression", 3: "path", 4: None}


def test_reports_are_json_or_xml(spark):
    import json
    from xml.etree import ElementTree

    f = spark.createDataFrame([("a#b", "s<1>", "f&g", 3, "error"), ("a#b", "s", None, None, "info")], "channel string, subject_key string, file string, line int, severity string")
    for make in (formats.findings_json, formats.gitlab, formats.sarif_results):
        assert all(json.loads(r.value) for r in make(f).collect())
    assert all(ElementTree.fromstring(r.value) is not None for r in formats.checkstyle(f).collect())
    assert formats.text_lines(f).count() == formats.github_lines(f).count() == 2

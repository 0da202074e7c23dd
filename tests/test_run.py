import pytest

from codestrata.__main__ import main
from codestrata.operators.rules import RULES, unrun
from codestrata.plans.golden import FILES
from codestrata.run import analyse
from codestrata.sources.config import ConfigError, yaml_layer


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("project")
    for name, text in FILES:
        at = top / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    return top


def test_every_rule_meets_its_columns(spark):
    files = spark.createDataFrame([(n, t, "@generated" in t) for n, t in FILES], "file string, text string, is_generated boolean")
    run = analyse(files)
    project = spark.createDataFrame([], "subject_key string, duplicate_lines double, cycle_size double")
    assert unrun({"callable": run.callables, "class": run.classes, "namespace": run.namespaces, "project": project}, RULES) == {}
    found = {(r.channel, r.subject_key) for r in run.findings.collect()}
    assert {("security.xss#security.xss", "file:src/Unsafe.php"), ("code-smell.unused-private#code-smell.unused-private", "Shop\\Cart"), ("code-smell.unreachable-code#code-smell.unreachable-code", "Math::walk")} <= found
    assert {("design.data-class#design.data-class", "Shop\\Model\\Holder"), ("code-smell.exit#code-smell.exit", "file:src/Notes.php")} <= found
    removed = {(r.channel.split("#")[0], r.file): r.removed_by for r in run.projected.where("file LIKE '%Notes.php'").collect()}
    assert removed["code-smell.exit", "src/Notes.php"] == "suppression"  # by the comment above its line
    reasons = sorted(r.reason for r in run.diagnoses.collect())
    assert "malformed" in reasons and "unused" in reasons
    assert {r.status: r["count"] for r in run.coverage().groupBy("status").count().collect()} == {"analysed": 7, "failed": 2, "generated": 1}
    assert run.verdict().first().exit_code == 2


def test_choice_of_rules_and_exclusions(spark):
    files = spark.createDataFrame([(n, t, "@generated" in t) for n, t in FILES], "file string, text string, is_generated boolean")
    run = analyse(files, {"code-smell.unreachable-code": {"warning": 2, "error": 3}}, only=["code-smell.unreachable-code", "security"], exclude_paths=["src/Unsafe.php"])
    rows = {(r.channel.split("#")[0], r.severity, r.removed_by) for r in run.projected.collect()}
    assert ("code-smell.unreachable-code", "warning", None) in rows and ("security.xss", "error", "path") in rows
    assert {c.split(".")[0] for c, _, _ in rows} == {"code-smell", "security"}


def test_commands(spark, folder, tmp_path, capsys):
    assert main(["check", str(folder), "--format", "text", "--only", "security"], spark) == 2
    assert "security.sql-injection" in capsys.readouterr().out
    base = str(tmp_path / "base")
    assert main(["baseline", str(folder), "--baseline", base], spark) == 0
    capsys.readouterr()
    assert main(["check", str(folder), "--baseline", base, "--fail-on", "warning"], spark) == 0  # all of it is accepted
    assert main(["graph", str(folder), "--namespace", "Shop"], spark) == 0
    assert "Shop\\\\Base" in capsys.readouterr().out
    assert main(["rules"]) == 0 and "complexity.wmc#complexity.wmc 50 80" in capsys.readouterr().out


def test_yaml_configuration():
    pytest.importorskip("yaml")
    assert yaml_layer("rules:\n  complexity.wmc: {warning: 5}\nfailOn: warning\n") == {"rules": {"complexity.wmc": {"warning": 5}}, "failOn": "warning"} and yaml_layer("") == {}
    for bad in ("- a", "nonsense: 1", "a: [", "1: 2"):
        with pytest.raises(ConfigError):
            yaml_layer(bad)


def test_a_baseline_that_changed_meanwhile_is_not_replaced(spark, tmp_path):
    from codestrata.sources.baseline import content_hash, write_baseline

    path, lines = str(tmp_path / "b"), spark.createDataFrame([("{\"a\":[]}",), ("{\"b\":[]}",)], "value string")
    first = write_baseline(lines, path)
    assert first == content_hash(lines.orderBy("value")) == content_hash(spark.read.text(path))
    with pytest.raises(RuntimeError, match="another one"):
        write_baseline(lines.limit(1), path)
    assert write_baseline(lines.limit(1), path, first) != first and spark.read.text(path).count() == 1

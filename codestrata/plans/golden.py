"""A small PHP project and small tables whose measures, entries and findings were worked out by hand.

SQL can't parse PHP, so these queries run over the sources below, whatever the data folder, and their SQL is the list of
expected rows. They cover what the queries over whole tables can't be compared on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions.matching import selected
from codestrata.functions.text import is_generated, is_sensitive_name
from codestrata.operators import clones, formula, graph, policy, rank, rollup, rules
from codestrata.plans.base import rounded
from codestrata.sources.baseline import baseline_json, migrate, read_lines
from codestrata.sources.files import coverage, edges_of, new_files, php_facts, php_tokens

MATH = """<?php
namespace Math;
function add($a, $b) { return $a + $b; }
function sign(int $n): int
{
    if ($n > 0) {
        return 1;
    } elseif ($n < 0) {
        return -1;
    }
    return 0;
}
function walk(array $rows, ?callable $f, bool $deep, $x, $y): array
{
    $out = [];
    foreach ($rows as $k => $row) {
        if ($row === null || $deep && $k) {
            continue;
        }
        while ($f !== null) {
            try {
                $out[] = $f($row) ?? walk($row, $f, $deep, 1, 2);
                break;
            } catch (\\RuntimeException $e) {
                $x = $x ? 1 : 2;
            }
        }
    }
    return $out;
    echo 'never';
    $y = 1;
}
"""
CART = """<?php
declare(strict_types=1);

namespace Shop;

use Shop\\Model\\Item;
use Shop\\Model\\Price as Money;

// a cart
final class Cart extends Base implements \\Countable
{
    use Counts;

    private array $items = [];
    private ?Money $total = null;
    private $unused;

    public function __construct(private readonly Clock $clock, $strict = false)
    {
    }

    public function add(Item $item, int $n): void
    {
        if ($n > 0 && $item->isSold()) {
            for ($i = 0; $i < $n; $i++) {
                $this->items[] = $item;
            }
        } elseif ($n < 0) {
            throw new \\InvalidArgumentException('n');
        }
    }

    public function count(): int
    {
        return count($this->items);
    }

    public function getTotal(): ?Money
    {
        return $this->total;
    }

    private function never()
    {
        return Registry::get(self::class);
    }
}
"""
MODEL = """<?php
namespace Shop\\Model;
interface Priced { public function price(): int; }
abstract class Thing implements Priced { abstract protected function name(): string; }
enum Size: string implements Priced { case S = 's'; case L = 'l'; public function price(): int { return 1; } }
trait Named { private $name; public function name() { return $this->name; } }
final readonly class Point { public function __construct(public int $x, public int $y) {} }
class Holder { public $a; public $b; private $c; public function getC() { return $this->c; } public function setC($c) { $this->c = $c; } }
"""
BAD = """<?php
namespace Bad;
function login(string $password, #[\\SensitiveParameter] string $secret, bool $remember) {
    var_dump($password);
    @unlink('x'); // @unlink in a comment is none
    eval('1;');
    try { f(); } catch (\\Exception $e) { }
    for ($i = 0; $i < count($_FILES); $i++) { }
    goto end;
    end:
    exit(1);
}
"""
UNSAFE = """<?php
$a = "SELECT * FROM t WHERE id = " . $_GET['id'];
$b = "SELECT * FROM t WHERE id = {$_POST['x']}";
$c = 'select 1 where ' . intval($_GET['a']);
mysqli_query($db, $_REQUEST['q']);
$d = sprintf('DELETE FROM t WHERE a = %s', $_COOKIE['c']);
echo $_GET['x'], htmlspecialchars($_GET['y']);
print "hi " . $_POST['z'];
echo "x $_GET[name]";
?>
<b><?= $_GET['q'] ?></b>
<?php
exec('ls ' . $_GET['d']);
system(escapeshellarg($_GET['d']));
echo (int) $_GET['n'];
if ($a == 1) { f(); } elseif ($a == 2) { g(); } elseif ($a == 1) { h(); }
switch ($a) { case 1: break; case 2: break; case 1: break; }
$m = match($a) { 1, 2 => 3, 2 => 4, default => 5 };
$t = $a ? $b : $b;
$u = $a && $a;
"""
NOTES = """<?php
namespace Notes;
// @codestrata-ignore-file complexity -- old code
/** @ignore size.method-count -- on purpose */
class A {
    // @ignore-next-line code-smell.exit
    public function f() { exit; }
    /** @threshold complexity.cyclomatic warning=5 error=9 */
    public function g() {}
    /** @threshold design.noc 7 and more; `@ignore this` */
    public function h() {}
    /** @threshold maintainability.index 30 */
    public function i() {}
}
"""
FILES = [
    ("src/Math.php", MATH), ("src/Shop/Cart.php", CART), ("src/Shop/Model.php", MODEL), ("src/Bad.php", BAD), ("src/Unsafe.php", UNSAFE), ("src/Notes.php", NOTES),
    ("src/Cut.php", "<?php\n\nnamespace Lun"), ("src/Open.php", "<?php class A { function f() { return 1; }"), ("src/Made.php", "<?php\n// @generated\nclass Made {}\n"), ("src/Plain.php", "no code\n"),
]


def _files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FILES, "file string, text string").withColumn("is_generated", is_generated(F.col("text")))


def _facts(spark: SparkSession) -> DataFrame:
    return php_facts(_files(spark).where("NOT is_generated"))


def _values(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return rows.select("file", "subject", "line", *[F.round(F.col("values")[n], 6).alias(n.replace(".", "_")) for n in names])


def golden_callables(spark: SparkSession, folder: str) -> DataFrame:
    names = ("ccn", "cognitive", "npath", "statements", "parameters", "isVoConstructor", "unreachable", "unreachableLine")
    return _values(_facts(spark).where("kind = 'callable' AND file IN ('src/Math.php', 'src/Shop/Cart.php', 'src/Shop/Model.php')"), names)


def golden_halstead(spark: SparkSession, folder: str) -> DataFrame:
    names = ("halstead.volume", "halstead.difficulty", "halstead.effort", "halstead.bugs", "halstead.time", "mi")
    return _values(_facts(spark).where("kind = 'callable' AND subject IN ('Math::add', 'Math::sign')"), names)


def golden_classes(spark: SparkSession, folder: str) -> DataFrame:
    names = ("lcom", "tcc", "lcc", "rfc", "rfc_own", "rfc_external", "wmc", "methodCountTotal", "methodCount", "getterCount", "setterCount", "propertyCount", "woc", "isDataClass", "isReadonly", "isAbstract", "isInterface", "isPromotedOnly")
    return _values(_facts(spark).where("kind = 'class' AND file LIKE 'src/Shop/%'"), names)


def golden_class_details(spark: SparkSession, folder: str) -> DataFrame:
    names = (
        "classLoc", "methodCount.public", "methodCount.protected", "methodCount.private", "propertyCount.public", "propertyCount.private", "typeCoverage.param.total", "typeCoverage.param.typed", "typeCoverage.return.total",
        "typeCoverage.return.typed", "typeCoverage.property.total", "typeCoverage.property.typed", "typeCoverage.pct", "unusedPrivate", "constructorParameters",
    )
    return _values(_facts(spark).where("kind = 'class' AND file LIKE 'src/Shop/%'"), names)


def golden_inheritance(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds, parents, interfaces and ordinals of classes, as the file says them."""
    rows = _facts(spark).where("kind = 'class'")
    return rows.select("subject", *[F.col("extra")[c].alias(c) for c in ("kind", "namespace", "ordinal", "extends", "implements")])


def golden_files(spark: SparkSession, folder: str) -> DataFrame:
    names = ("loc", "blank", "cloc", "lloc", "functionCount", "classCount", "abstractCount", "interfaceCount", "traitCount", "enumCount")
    return _values(_facts(spark).where("kind = 'file' AND file <> 'src/Unsafe.php'"), names).drop("subject", "line")


def golden_edges(spark: SparkSession, folder: str) -> DataFrame:
    return edges_of(_facts(spark)).select("src_class", "dst_class", "dep_type", "line").distinct()


def golden_coupling(spark: SparkSession, folder: str) -> DataFrame:
    """Coupling within the project, without the language's classes, framework names apart."""
    edges = graph.without_builtins(edges_of(_facts(spark)))
    return rounded(graph.class_coupling(edges, ["Shop\\Model"])).drop("project")


def _entries(spark: SparkSession) -> DataFrame:
    rows = _facts(spark)
    found = rows.where("kind = 'entry'").select("file", F.col("subject").alias("kind"), "line", F.col("extra")["detail"].alias("extra"))
    names = rows.where("kind = 'parameter' AND extra['sensitive'] = 'false'").where(is_sensitive_name(F.col("subject")))
    return found.unionByName(names.select("file", F.lit("sensitive_parameter").alias("kind"), "line", F.col("subject").alias("extra")))


def golden_entries(spark: SparkSession, folder: str) -> DataFrame:
    return _entries(spark).where("kind <> 'superglobals'")


def golden_entry_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of every rule on entries; one superglobal and one suppressed call are allowed."""
    found = rules.entry_findings(_entries(spark), allowed={"superglobals": ["$_GET", "$_POST"], "boolean_argument": ["remember"]})
    return found.groupBy("channel", "severity", "minutes").agg(F.count("*").alias("findings"), F.min("line").alias("first_line"))


def golden_directives(spark: SparkSession, folder: str) -> DataFrame:
    rows = _facts(spark).where("kind = 'directive'")
    return rows.select(F.col("subject").alias("kind"), "line", *[F.coalesce(F.col("extra")[c], F.lit("")).alias(c) for c in ("selector", "reason", "warning", "error", "malformed")])


def golden_bindings(spark: SparkSession, folder: str) -> DataFrame:
    """The declaration that each directive of the fixture belongs to."""
    rows = _facts(spark).where("file = 'src/Notes.php'")
    directives = rows.where("kind = 'directive'").select(F.col("line").alias("directive_id"), "file", "line")
    ends = F.when(F.col("kind") == "class", F.col("line") + F.col("values")["classLoc"].cast("int") - 1).otherwise(F.col("extra")["end_line"].cast("int"))
    scopes = rows.where("kind IN ('class', 'callable')").select("file", F.col("line").alias("start"), ends.alias("end"), F.col("subject").alias("subject_key"), F.when(F.col("kind") == "class", 1).otherwise(2).alias("scope_rank"))
    return policy.bind_directives(directives, scopes).select("line", "subject_key", "scope_rank")


def golden_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return coverage(_files(spark), _facts(spark)).select("file", "status")


# ---- rules ----


def _cases(rule: rules.Rule) -> list[tuple[str, float]]:
    """Values just short of a warning, at each threshold, and beyond the last."""
    step = 1.0 if rule.whole else 0.01
    toward = -step if rule.worse == "higher" else step
    out = [("short", rule.warning + toward if rule.worse == "higher" else rule.warning), ("warning", rule.warning if rule.worse == "higher" else rule.warning - step)]
    if rule.error is not None:
        out.append(("error", rule.error if rule.worse == "higher" else rule.error - step))
    return out


def golden_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Each threshold rule on a subject short of its warning, at its warning and at its error: rule and case, severity and
    the threshold reported. Gates are open; `golden_gates` closes them."""
    gates = {"statements": 10, "method_count": 3, "class_count": 3, "ca": 1}
    found = None
    for at, rule in enumerate(r for r in rules.RULES if r.enabled):
        rows = spark.createDataFrame([(f"{rule.code} {case}", "f.php", at, float(value)) for case, value in _cases(rule)], f"subject_key string, file string, line int, {rule.metric} double")
        for gate in rule.needs:
            if gate not in rows.columns and not gate.startswith("is_"):
                rows = rows.withColumn(gate, F.lit(gates[gate]))
        for gate in ("is_leaf", "is_vo_constructor"):
            if gate in rule.needs:
                rows = rows.withColumn(gate, F.lit(rule.code.endswith(".vo") or gate == "is_leaf"))
        part = rules.run_rules({rule.level: rows}, [rule], strict=True)
        found = part if found is None else found.unionByName(part)
    return found.select("channel", "subject_key", "severity", "threshold", "minutes")


def golden_gates(spark: SparkSession, folder: str) -> DataFrame:
    """Subjects far beyond every threshold, of which each rule's gate lets some through."""
    schema = "subject_key string, file string, line int, lcom double, method_count double, property_count double, is_readonly boolean, is_promoted_only boolean, cbo double, instability double, ca double, mi double, statements double, is_test boolean, parameter_count double, is_vo_constructor boolean"
    rows = spark.createDataFrame(
        [
            ("plain", "f", 1, 9.0, 3.0, 99.0, False, False, 99.0, 1.0, 1.0, 5.0, 10.0, False, 7.0, False),
            ("readonly", "f", 2, 9.0, 3.0, 99.0, True, False, 99.0, 1.0, 0.0, 5.0, 9.0, False, 7.0, True),
            ("promoted", "f", 3, 9.0, 2.0, 99.0, False, True, None, float("nan"), 1.0, 5.0, 10.0, True, 12.0, True),
            ("unknown", "f", 4, None, 3.0, None, None, None, 14.9, 0.7999, 1.0, None, 10.0, None, None, None),
        ],
        schema,
    )
    wanted = [r for r in rules.RULES if r.code in ("cohesion.lcom", "size.property-count", "coupling.cbo.class", "coupling.instability.class")]
    callables = [r for r in rules.RULES if r.code in ("maintainability.index",) or r.name == "code-smell.long-parameter-list"]
    found = rules.run_rules({"class": rows}, wanted).unionByName(rules.run_rules({"callable": rows}, callables))
    return found.select("channel", "subject_key", "severity", "value", "threshold")


def golden_god_classes(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.createDataFrame(
        [
            ("all four", 10, 47.0, 3.0, 0.32, 300.0, False), ("three of four", 10, 47.0, 3.0, 0.33, 300.0, False), ("cohesive", 10, 47.0, 9.0, 0.5, 300.0, False), ("three known", 10, 50.0, None, 0.1, 300.0, None),
            ("two known", 10, 50.0, None, None, 300.0, False), ("readonly", 10, 50.0, 9.0, 0.1, 900.0, True), ("two methods", 2, 50.0, 9.0, 0.1, 900.0, False), ("small", 10, 46.0, 2.0, 0.4, 299.0, False),
        ],
        "subject_key string, method_count int, wmc double, lcom double, tcc double, class_loc double, is_readonly boolean",
    )
    return rules.god_class(rows).select("subject_key", "matched", "evaluable", "severity")


def golden_data_classes(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.createDataFrame(
        [("data", 33.0, 10.0, 3, False, False, False), ("active", 34.0, 10.0, 3, False, False, False), ("complex", 33.0, 11.0, 3, False, False, False), ("small", 0.0, 1.0, 2, False, False, False),
         ("readonly", 0.0, 1.0, 5, True, False, False), ("exception", 0.0, 1.0, 5, False, True, False), ("promoted", 0.0, 1.0, 5, False, False, True), ("unknown", 0.0, 1.0, 5, None, None, None)],
        "subject_key string, woc double, wmc double, members int, is_readonly boolean, is_exception boolean, is_promoted_only boolean",
    )
    return rules.data_class(rows).select("subject_key", "severity")


def golden_rank_findings(spark: SparkSession, folder: str) -> DataFrame:
    """400 classes: the thresholds 0.02 and 0.05 are halved."""
    rows = spark.range(400).select(F.lit("p").alias("project"), F.concat(F.lit("C"), "id").alias("class"), F.when(F.col("id") == 0, 0.025).when(F.col("id") == 1, 0.01).when(F.col("id") == 2, 0.0099).otherwise(0.001).alias("rank"))
    return rules.rank_findings(rows).select("class", "severity")


def golden_computed(spark: SparkSession, folder: str) -> DataFrame:
    """Health scores are bad below their thresholds, a custom metric above its own."""
    rows = spark.createDataFrame([("a", "f", 1, 49.94, 9.0), ("b", "f", 2, 49.96, 11.0), ("c", "f", 3, 20.0, 30.0), ("d", "f", 4, None, None)], "subject_key string, file string, line int, health__cohesion double, computed__risk double")
    found = rules.computed_findings(rows, {"health.cohesion": (*formula.HEALTH_THRESHOLDS["cohesion"], True), "computed.risk": (10.0, 20.0, False)})
    return found.select("channel", "subject_key", "severity", "value", "threshold")


def golden_diagnoses(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.createDataFrame(
        [
            (1, "symbol", "complexity", None, None, False), (2, "symbol", "no.such.rule", None, None, False), (3, "threshold", "code-smell.exit", 1.0, 2.0, False), (4, "threshold", "complexity.cyclomatic", None, None, True),
            (5, "threshold", "complexity.cyclomatic", 9.0, 5.0, False), (6, "threshold", "maintainability.index", 9.0, 5.0, False), (7, "threshold", "maintainability.index", 5.0, 9.0, False), (8, "threshold", "complexity.cyclomatic", -1.0, 5.0, False),
            (9, "threshold", "code-smell.unused-private", 2.0, 3.0, False), (10, "threshold", "code-smell.unused-private", 2.0, None, False), (11, "file", "*", None, None, False), (12, "next-line", "code-smell.exit", None, None, False),
        ],
        "directive_id long, kind string, selector string, warning double, error double, malformed boolean",
    )
    catalogue = [(r.channel, "magnitude", r.worse, r.error is None) for r in rules.RULES] + [(f"{n}#{n}", "occurrence", "higher", False) for n, _, _ in rules.ENTRY_RULES.values()]
    unused = spark.createDataFrame([(2,), (12,)], "directive_id long")
    return policy.diagnose(rows, spark.createDataFrame(catalogue, "channel string, shape string, worse string, warning_only boolean"), unused)


def golden_sorts(spark: SparkSession, folder: str) -> DataFrame:
    """The place of each finding in every order of reports."""
    rows = spark.createDataFrame(
        [(1, "r.b#x", "N\\B::m", "b.php", 5, "warning", "N\\B", "N"), (2, "r.a#x", "N\\A::m", "b.php", 2, "error", "N\\A", "N"), (3, "r.a#x", "M\\A::m", "a.php", None, "warning", "M\\A", "M"), (4, "r.c#x", None, None, None, "error", None, None)],
        "id int, channel string, subject_key string, file string, line int, severity string, class_key string, namespace string",
    )
    parts = [rank.sort_findings(rows, by).select(F.lit(by).alias("order"), "id", F.monotonically_increasing_id().alias("at")) for by in rank.SORTS]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("order").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]), " ").alias("ids"))


def golden_merged(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of a subject from two runs, the later winning, and explicit namespace values before those of files."""
    a = spark.createDataFrame([("s", "ccn", 1.0), ("s", "loc", 5.0)], "subject_key string, metric string, value double")
    b = spark.createDataFrame([("s", "ccn", 2.0), ("t", "ccn", 7.0)], "subject_key string, metric string, value double")
    return rollup.merge_right(a, b, ["subject_key", "metric"])


def golden_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Exit codes by what was found and what the run fails on."""
    found = {"nothing": [], "warning": [("w#w", "warning")], "error": [("e#e", "error")], "config": [("c#c", "warning")]}
    out = None
    for name, rows in found.items():
        df = spark.createDataFrame(rows, "channel string, severity string")
        for fail_on in ("error", "warning", "none"):
            part = policy.verdict(df, fail_on, config_channels=["c#c"]).select(F.lit(name).alias("found"), F.lit(fail_on).alias("fail_on"), "exit_code")
            out = part if out is None else out.unionByName(part)
    return out.unionByName(policy.verdict(spark.createDataFrame(found["error"], "channel string, severity string"), complete=False).select(F.lit("cut short").alias("found"), F.lit("error").alias("fail_on"), "exit_code"))


_FINDINGS = "channel string, subject_key string, file string, namespace string, severity string, value double, occ_key string, dep_target string, dep_type string"


def _found(spark: SparkSession) -> DataFrame:
    rows = [
        ("complexity#ccn", "A::f", "src/a.php", "A", "warning", 12.0, None, None, None), ("complexity#ccn", "A::f", "src/a.php", "A", "error", 25.0, None, None, None), ("layer#edge", "A", "src/a.php", "A", "error", None, None, "B", "new"),
        ("layer#edge", "A", "src/a.php", "A", "error", None, None, "C", "extends"), ("smell#exit", "file:src/b.php", "src/b.php", "B\\Gen", "warning", None, "exit", None, None), ("mi#mi", "B::g", "lib/b.php", "B", "warning", 38.0, None, None, None),
    ]
    return spark.createDataFrame(rows, _FINDINGS)


def golden_baseline_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """A baseline written as JSON and read again: occurrences, edges and magnitudes come back."""
    made = policy.generate_baseline(_found(spark))
    back = read_lines(baseline_json(made))
    return back.select(F.replace("identity_key", F.lit(policy.SEPARATOR), F.lit("|")).alias("identity_key"), F.array_join("magnitudes", " ").alias("magnitudes"), "count", "inert")


def _later(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(baseline, judgement of a later state, channels): one finding of two is gone, one got worse, one channel isn't declared."""
    base = policy.generate_baseline(_found(spark))
    now = _found(spark).where("NOT (channel = 'complexity#ccn' AND value = 25) AND coalesce(dep_target, '') <> 'C' AND channel <> 'smell#exit'").withColumn("value", F.when(F.col("channel") == "mi#mi", 30.0).otherwise(F.col("value")))
    channels = spark.createDataFrame([("complexity#ccn", "magnitude", "higher"), ("mi#mi", "magnitude", "lower"), ("layer#edge", "occurrence", "higher")], "channel string, shape string, worse string")
    return base, policy.judge(now, base, channels), channels


def golden_baseline_judged(spark: SparkSession, folder: str) -> DataFrame:
    base, judged, _ = _later(spark)
    new = policy.update_baseline(base, judged).select("identity_key", "outcome", "count")
    return judged.select("identity_key", "verdict").join(new, "identity_key").select(F.replace("identity_key", F.lit(policy.SEPARATOR), F.lit("|")).alias("identity_key"), "verdict", "outcome", "count")


def golden_baseline_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    base, judged, channels = _later(spark)
    return policy.clean_baseline(base, judged, channels).select(F.replace("identity_key", F.lit(policy.SEPARATOR), F.lit("|")).alias("identity_key"), "reason")


def golden_baseline_applied(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of the later state: within the baseline, or errors as a group that breaches it."""
    base, judged, _ = _later(spark)
    rows = policy.apply_baseline(_found(spark).where("channel IN ('mi#mi', 'complexity#ccn')"), judged)
    return rows.select("channel", "value", "severity", "verdict", F.array_join("accepted", " ").alias("accepted"))


def golden_baseline_explained(spark: SparkSession, folder: str) -> DataFrame:
    defaults = spark.createDataFrame([("complexity#ccn", 20.0), ("mi#mi", 20.0)], "channel string, error double")
    inline = spark.createDataFrame([("B::g", "mi#mi", 15.0), ("A::f", "complexity#ccn", 22.0)], "subject_key string, channel string, error double")
    subjects = spark.createDataFrame([("A::f",), ("B::g",), ("C::h",)], "subject_key string")
    base = policy.generate_baseline(_found(spark).where("channel = 'complexity#ccn'"))
    return policy.explain(subjects, defaults, inline, base)


def golden_baseline_migrated(spark: SparkSession, folder: str) -> DataFrame:
    old = spark.createDataFrame([("a.php", "complexity", "f"), ("a.php", "complexity", "f"), ("a.php", "size", "twice"), ("b.php", "size", "gone")], "file string, rule string, symbol string")
    symbols = spark.createDataFrame([("a.php", "f", "A::f"), ("a.php", "twice", "A::t"), ("a.php", "twice", "B::t")], "file string, symbol string, subject_key string")
    return migrate(old, symbols).select(F.replace("identity_key", F.lit(policy.SEPARATOR), F.lit("|")).alias("identity_key"), "count", "reason")


def golden_scope(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of a run that the recorded scope doesn't cover."""
    run = spark.createDataFrame([("src",), ("src/a/b",), ("srcs",), ("lib/x/",), ("lib",)], "path string")
    return policy.uncovered(run, spark.createDataFrame([("src/",), ("lib/x",)], "path string"))


def golden_excluded(spark: SparkSession, folder: str) -> DataFrame:
    """What per-rule exclusions leave: one rule out of a path, one channel out of a namespace."""
    left = policy.exclude_by_rule(_found(spark), paths={"complexity": ["src"], "mi": ["src"]}, namespaces={"smell#exit": ["B"], "layer": ["Other"]})
    return left.select("channel", "subject_key")


def golden_selected(spark: SparkSession, folder: str) -> DataFrame:
    """Channels that stay when some rules are chosen and some are switched off."""
    rows = spark.createDataFrame([(c,) for c in ("complexity.cyclomatic#complexity.cyclomatic.callable", "complexity.cyclomatic#complexity.cyclomatic.class", "complexity.wmc#complexity.wmc", "size.method-count#size.method-count", "size#size")], "channel string")
    gates = {"all": ((), ()), "family": (["complexity"], []), "below": (["size.*"], []), "pair": (["complexity.wmc#complexity.wmc"], []), "without": (["complexity"], ["complexity.cyclomatic.class"]), "none": ([], ["complexity", "size"])}
    parts = [rows.where(selected(F.col("channel"), *g)).select(F.lit(n).alias("gate"), "channel") for n, g in gates.items()]
    return reduce(DataFrame.unionByName, parts)


def golden_contributions(spark: SparkSession, folder: str) -> DataFrame:
    """Two rounds of roll-up: a file in two namespaces, an explicit value before those of files, ancestors from raw values."""
    callables = spark.createDataFrame([("p", "A\\B", 1.0), ("p", "A\\B", 3.0), ("p", "A", 5.0), ("p", "C", 7.0)], "project string, namespace string, ccn double")
    files = spark.createDataFrame([("p", "1.php", "A\\B", 10), ("p", "1.php", "C", 10), ("p", "2.php", "A", 20), ("p", "3.php", "D\\E", 40)], "project string, file string, namespace string, loc int")
    explicit = spark.createDataFrame([("p", "C", 6)], "project string, namespace string, loc long")
    out = rollup.namespace_rounds(callables, files, explicit, ["ccn"], ["loc"])
    return out.select("namespace", "ccn_sum", "ccn_avg", "ccn_count", "loc_sum")


def golden_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs as one: how many measures, what a repeated one is, findings, time, and whether it is complete."""

    def run(measures: list, findings: int, seconds: float, complete: bool) -> dict[str, DataFrame]:
        return {
            "metrics": spark.createDataFrame(measures, "subject_key string, metric string, value double"), "findings": spark.range(findings).select(F.col("id").cast("string").alias("channel")),
            "run": spark.createDataFrame([(seconds, complete)], "seconds double, complete boolean"),
        }

    both = rollup.merge_runs(run([("s", "ccn", 1.0), ("t", "ccn", 4.0)], 2, 9.0, True), run([("s", "ccn", 2.0)], 3, 5.0, False))
    m = both["metrics"].agg(F.count("*").alias("measures"), F.max(F.when(F.col("subject_key") == "s", F.col("value"))).alias("repeated"))
    return m.crossJoin(both["findings"].agg(F.count("*").alias("findings"))).crossJoin(both["run"])  # one row each


def golden_new_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files whose content no earlier run has seen."""
    files = spark.createDataFrame([("a.php", "<?php 1;"), ("b.php", "<?php 2;"), ("moved.php", "<?php 1;"), ("empty.php", "")], "file string, text string")
    known = files.where("file = 'a.php'").select(F.xxhash64("text").alias("content_hash"))
    return new_files(files, known).select("file")


def golden_weights(spark: SparkSession, folder: str) -> DataFrame:
    """The overall score without a dimension: the other weights grow to a sum of 1; a missing part counts 75."""
    kept = formula.without_dimension(formula.CLASS_WEIGHTS, {"typing"})
    rows = spark.createDataFrame([("all", 80.0, 60.0, 40.0), ("missing", 80.0, None, None)], "subject_key string, health__complexity double, health__cohesion double, health__coupling double")
    out = formula.compute(rows, {"health.overall": formula.overall(kept)})
    return out.select("subject_key", F.round("health__overall", 6).alias("overall"))


def golden_duplication(spark: SparkSession, folder: str) -> DataFrame:
    """Clones of a fixture: a run of 12 tokens twice in one file and once in another; blocks inside larger ones are dropped."""
    body = [f"t{i}" for i in range(12)]
    files = spark.createDataFrame([("a", ["x", *body, "y", "z", *body, "w"]), ("b", ["q", *body, "r"]), ("c", ["u"] * 5)], "file string, tokens array<string>")
    pairs = clones.clone_pairs(files, 6)
    blocks = clones.clone_blocks(pairs, files).withColumn("group", F.lit(1))
    return clones.greedy_cover(blocks).select("tokens", F.array_join(F.transform("places", lambda p: F.concat_ws(":", p["file"], p["pos"])), " ").alias("places"))


def golden_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Normalised tokens with their lines."""
    rows = spark.createDataFrame([("a", "<?php // c\n$x = 'y' .\n  1.5; /* d\n */ ?>\nhtml <?= f(\"a $b\") ?>"), ("b", None)], "file string, text string")
    return php_tokens(rows).select("file", F.array_join("tokens", " ").alias("tokens"), F.array_join("lines", " ").alias("lines"))


def golden_verified(spark: SparkSession, folder: str) -> DataFrame:
    """Clones with their lines; a table of constants is none."""
    code = "<?php\n" + "\n".join(f"f{i}($a, {i});" for i in range(6))
    data = "<?php\nreturn [" + ",\n".join(f"'k{i}' => {i}" for i in range(20)) + "];"
    files = php_tokens(spark.createDataFrame([("a", code), ("b", code + "\ng();"), ("c", data), ("d", data + "\nh();")], "file string, text string"))
    return clones.verified(clones.clone_pairs(files.select("file", "tokens"), 20), files).select("a_file", "a_pos", "b_file", "b_pos", "tokens", "lines")


def golden_sensitive_names(spark: SparkSession, folder: str) -> DataFrame:
    names = ["password", "userPassword", "passwordHash", "is_password", "apiKey", "API_KEY", "key", "primaryKey", "accessToken", "token", "csrf_token", "secretary", "oldPasswd", "passwordResetToken", "", "credentials", "encryptionKeyPath", "dbPwd", "myAuthToken2"]
    rows = spark.createDataFrame([(n,) for n in [*names, None]], "name string")
    return rows.where(is_sensitive_name(F.col("name")))


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("golden_")}


def _sql(columns: str, *rows: str, doubles: str = "") -> str:
    """Rows as SQL; the columns `doubles`, or with 'rest' all behind `line`, are doubles."""
    names = columns.split(", ")
    wide = set(names[names.index("line") + 1 :] if doubles == "rest" and "line" in names else names[1:] if doubles == "rest" else doubles.split(", ")) & set(names)
    picked = ", ".join(f"{n}::DOUBLE AS {n}" if n in wide else n for n in names)
    return f"SELECT {picked} FROM (VALUES {', '.join(f'({r})' for r in rows)}) t({columns})"


_C = "file, subject, line, "
ORACLE = {
    "golden_callables": _sql(
        _C + "ccn, cognitive, npath, statements, parameters, isVoConstructor, unreachable, unreachableLine",
        "'src/Math.php', 'Math::add', 3, 1, 0, 1, 1, 2, 0, 0, 0", "'src/Math.php', 'Math::sign', 4, 3, 2, 3, 5, 1, 0, 0, 0", "'src/Math.php', 'Math::walk', 13, 9, 13, 21, 13, 5, 0, 2, 30",
        "'src/Shop/Cart.php', 'Shop\\Cart::__construct', 18, 1, 0, 1, 0, 2, 0, 0, 0", "'src/Shop/Cart.php', 'Shop\\Cart::add', 22, 5, 5, 5, 5, 2, 0, 0, 0", "'src/Shop/Cart.php', 'Shop\\Cart::count', 33, 1, 0, 1, 1, 0, 0, 0, 0",
        "'src/Shop/Cart.php', 'Shop\\Cart::getTotal', 38, 1, 0, 1, 1, 0, 0, 0, 0", "'src/Shop/Cart.php', 'Shop\\Cart::never', 43, 1, 0, 1, 1, 0, 0, 0, 0",
        "'src/Shop/Model.php', 'Shop\\Model\\Priced::price', 3, 1, 0, 1, 0, 0, 0, 0, 0", "'src/Shop/Model.php', 'Shop\\Model\\Thing::name', 4, 1, 0, 1, 0, 0, 0, 0, 0", "'src/Shop/Model.php', 'Shop\\Model\\Size::price', 5, 1, 0, 1, 1, 0, 0, 0, 0",
        "'src/Shop/Model.php', 'Shop\\Model\\Named::name', 6, 1, 0, 1, 1, 0, 0, 0, 0", "'src/Shop/Model.php', 'Shop\\Model\\Point::__construct', 7, 1, 0, 1, 0, 2, 1, 0, 0", "'src/Shop/Model.php', 'Shop\\Model\\Holder::getC', 8, 1, 0, 1, 1, 0, 0, 0, 0",
        "'src/Shop/Model.php', 'Shop\\Model\\Holder::setC', 8, 1, 0, 1, 1, 1, 0, 0, 0",
        doubles="rest",
    ),
    # by severity: errors first, then file, line; by class: the subject, then severity; a null file or namespace comes first
    "golden_sorts": """SELECT * FROM (VALUES ('severity', '4 2 3 1'), ('file', '4 3 2 1'), ('file_severity', '4 3 2 1'), ('rule', '3 2 1 4'), ('class', '4 3 2 1'), ('namespace', '4 3 2 1')) t("order", ids)""",
    # operators and operands, distinct and all: add has return + and $a $b; sign has if return > < - and $n 0 1
    "golden_halstead": """WITH c AS (SELECT * FROM (VALUES ('src/Math.php', 'Math::add', 3, 2, 2, 2, 2, 1, 1), ('src/Math.php', 'Math::sign', 4, 5, 3, 7, 7, 3, 5)) t(file, subject, line, n1, n2, m1, m2, ccn, stmts)),
v AS (SELECT *, (m1 + m2) * log2(n1 + n2) AS v, n1 / 2.0 * m2 / n2 AS d FROM c)
SELECT file, subject, line, round(v, 6) AS halstead_volume, round(d, 6) AS halstead_difficulty, round(v * d, 6) AS halstead_effort, round(v / 3000, 6) AS halstead_bugs, round(v * d / 18, 6) AS halstead_time,
round((171 - 5.2 * ln(v) - 0.23 * ccn - 16.2 * ln(stmts)) * 100 / 171, 6) AS mi FROM v""",
    "golden_classes": _sql(
        _C + "lcom, tcc, lcc, rfc, rfc_own, rfc_external, wmc, methodCountTotal, methodCount, getterCount, setterCount, propertyCount, woc, isDataClass, isReadonly, isAbstract, isInterface, isPromotedOnly",
        "'src/Shop/Cart.php', 'Shop\\Cart', 10, 3, round(1/3, 6), round(1/3, 6), 9, 5, 4, 9, 5, 3, 1, 0, 4, 67, 0, 0, 0, 0, 0",
        "'src/Shop/Model.php', 'Shop\\Model\\Priced', 3, 1, 1, 1, 1, 1, 0, 1, 1, 1, 0, 0, 0, 100, 0, 0, 0, 1, 0", "'src/Shop/Model.php', 'Shop\\Model\\Thing', 4, 0, 1, 1, 1, 1, 0, 1, 1, 1, 0, 0, 0, 100, 0, 0, 1, 0, 0",
        "'src/Shop/Model.php', 'Shop\\Model\\Size', 5, 1, 1, 1, 1, 1, 0, 1, 1, 1, 0, 0, 0, 100, 0, 0, 0, 0, 0", "'src/Shop/Model.php', 'Shop\\Model\\Named', 6, 1, 1, 1, 1, 1, 0, 1, 1, 1, 0, 0, 1, 100, 0, 0, 0, 0, 0",
        "'src/Shop/Model.php', 'Shop\\Model\\Point', 7, 0, 1, 1, 1, 1, 0, 1, 1, 0, 0, 0, 2, 0, 1, 1, 0, 0, 1", "'src/Shop/Model.php', 'Shop\\Model\\Holder', 8, 1, 1, 1, 2, 2, 0, 2, 2, 0, 1, 1, 3, 0, 1, 0, 0, 0, 0",
        doubles="rest",
    ),
    "golden_class_details": _sql(
        _C + "classLoc, methodCount_public, methodCount_protected, methodCount_private, propertyCount_public, propertyCount_private, typeCoverage_param_total, typeCoverage_param_typed, typeCoverage_return_total, typeCoverage_return_typed, "
        "typeCoverage_property_total, typeCoverage_property_typed, typeCoverage_pct, unusedPrivate, constructorParameters",
        "'src/Shop/Cart.php', 'Shop\\Cart', 10, 38, 4, 0, 1, 0, 4, 4, 3, 4, 3, 4, 3, 75, 3, 2",
        "'src/Shop/Model.php', 'Shop\\Model\\Priced', 3, 1, 1, 0, 0, 0, 0, 0, 0, 1, 1, 0, 0, 100, 0, 0", "'src/Shop/Model.php', 'Shop\\Model\\Thing', 4, 1, 0, 1, 0, 0, 0, 0, 0, 1, 1, 0, 0, 100, 0, 0",
        "'src/Shop/Model.php', 'Shop\\Model\\Size', 5, 1, 1, 0, 0, 0, 0, 0, 0, 1, 1, 0, 0, 100, 0, 0", "'src/Shop/Model.php', 'Shop\\Model\\Named', 6, 1, 1, 0, 0, 0, 1, 0, 0, 1, 0, 1, 0, 0, 0, 0",
        "'src/Shop/Model.php', 'Shop\\Model\\Point', 7, 1, 1, 0, 0, 2, 0, 2, 2, 0, 0, 2, 2, 100, 0, 2", "'src/Shop/Model.php', 'Shop\\Model\\Holder', 8, 1, 2, 0, 0, 2, 1, 1, 0, 2, 0, 3, 0, 0, 0, 0",
        doubles="rest",
    ),
    "golden_inheritance": _sql(
        "subject, kind, namespace, ordinal, extends, implements",
        "'Shop\\Cart', 'class', 'Shop', '1', 'Shop\\Base', 'Countable'", "'Shop\\Model\\Priced', 'interface', 'Shop\\Model', '1', '', ''", "'Shop\\Model\\Thing', 'abstract', 'Shop\\Model', '1', '', 'Shop\\Model\\Priced'",
        "'Shop\\Model\\Size', 'enum', 'Shop\\Model', '1', '', 'Shop\\Model\\Priced'", "'Shop\\Model\\Named', 'trait', 'Shop\\Model', '1', '', ''", "'Shop\\Model\\Point', 'class', 'Shop\\Model', '1', '', ''",
        "'Shop\\Model\\Holder', 'class', 'Shop\\Model', '1', '', ''", "'Notes\\A', 'class', 'Notes', '1', '', ''",
    ),
    "golden_files": _sql(
        "file, loc, blank, cloc, lloc, functionCount, classCount, abstractCount, interfaceCount, traitCount, enumCount",
        "'src/Math.php', 33, 1, 0, 32, 3, 0, 0, 0, 0, 0", "'src/Shop/Cart.php', 48, 10, 1, 37, 0, 1, 0, 0, 0, 0", "'src/Shop/Model.php', 9, 1, 0, 8, 0, 2, 1, 1, 1, 1", "'src/Bad.php', 13, 1, 0, 12, 1, 0, 0, 0, 0, 0",
        "'src/Notes.php', 15, 1, 6, 8, 0, 1, 0, 0, 0, 0", "'src/Plain.php', 2, 1, 0, 1, 0, 0, 0, 0, 0, 0",
        doubles="rest",
    ),
    "golden_edges": _sql(
        "src_class, dst_class, dep_type, line",
        "'Shop\\Cart', 'Shop\\Base', 'extends', 10", "'Shop\\Cart', 'Countable', 'implements', 10", "'Shop\\Cart', 'Shop\\Counts', 'trait_use', 12", "'Shop\\Cart', 'Shop\\Model\\Price', 'type_hint', 15", "'Shop\\Cart', 'Shop\\Clock', 'type_hint', 18",
        "'Shop\\Cart', 'Shop\\Model\\Item', 'type_hint', 22", "'Shop\\Cart', 'InvalidArgumentException', 'new', 29", "'Shop\\Cart', 'Shop\\Model\\Price', 'type_hint', 38", "'Shop\\Cart', 'Shop\\Registry', 'static_call', 45",
        "'Shop\\Model\\Thing', 'Shop\\Model\\Priced', 'implements', 4", "'Shop\\Model\\Size', 'Shop\\Model\\Priced', 'implements', 5",
    ),
    "golden_coupling": _sql(
        "class, ce, ca, cbo, ce_packages, ce_framework, cbo_app, instability",
        "'Shop\\Cart', 6, 0, 6, 0, 2, 4, 1.0", "'Shop\\Base', 0, 1, 1, 0, 0, 1, 0.0", "'Shop\\Counts', 0, 1, 1, 0, 0, 1, 0.0", "'Shop\\Model\\Price', 0, 1, 1, 0, 0, 1, 0.0", "'Shop\\Clock', 0, 1, 1, 0, 0, 1, 0.0", "'Shop\\Model\\Item', 0, 1, 1, 0, 0, 1, 0.0",
        "'Shop\\Registry', 0, 1, 1, 0, 0, 1, 0.0", "'Shop\\Model\\Priced', 0, 2, 2, 0, 0, 0, 0.0", "'Shop\\Model\\Thing', 1, 0, 1, 0, 1, 0, 1.0", "'Shop\\Model\\Size', 1, 0, 1, 0, 1, 0, 1.0",
        doubles="instability",
    ),
    "golden_entries": _sql(
        "file, kind, line, extra",
        "'src/Bad.php', 'sensitive_parameter', 3, 'password'", "'src/Bad.php', 'boolean_argument', 3, 'remember'", "'src/Bad.php', 'debug_code', 4, 'var_dump'", "'src/Bad.php', 'error_suppression', 5, 'unlink'", "'src/Bad.php', 'eval', 6, ''",
        "'src/Bad.php', 'empty_catch', 7, ''", "'src/Bad.php', 'count_in_loop', 8, 'count'", "'src/Bad.php', 'goto', 9, 'end'", "'src/Bad.php', 'exit', 11, ''", "'src/Notes.php', 'exit', 7, ''", "'src/Math.php', 'boolean_argument', 13, 'deep'",
        "'src/Unsafe.php', 'sql_injection', 2, '$_GET'", "'src/Unsafe.php', 'sql_injection', 3, '$_POST'", "'src/Unsafe.php', 'sql_injection', 5, '$_REQUEST'", "'src/Unsafe.php', 'sql_injection', 6, '$_COOKIE'",
        "'src/Unsafe.php', 'xss', 7, '$_GET'", "'src/Unsafe.php', 'xss', 8, '$_POST'", "'src/Unsafe.php', 'xss', 9, '$_GET'", "'src/Unsafe.php', 'xss', 11, '$_GET'", "'src/Unsafe.php', 'command_injection', 13, '$_GET'",
        "'src/Unsafe.php', 'identical_subexpression', 16, 'duplicate_condition'", "'src/Unsafe.php', 'identical_subexpression', 17, 'duplicate_switch_case'", "'src/Unsafe.php', 'identical_subexpression', 18, 'duplicate_match_arm'",
        "'src/Unsafe.php', 'identical_subexpression', 19, 'identical_ternary_branches'", "'src/Unsafe.php', 'identical_subexpression', 20, 'identical_operands &&'",
    ),
    "golden_entry_findings": "SELECT rule || '#' || rule AS channel, severity, minutes, findings, first_line FROM (VALUES "
    "('code-smell.boolean-argument', 'warning', 10, 1, 13), ('code-smell.count-in-loop', 'warning', 10, 1, 8), ('code-smell.debug-code', 'error', 5, 1, 4), ('code-smell.empty-catch', 'error', 10, 1, 7), ('code-smell.error-suppression', 'warning', 10, 1, 5), "
    "('code-smell.eval', 'error', 15, 1, 6), ('code-smell.exit', 'warning', 10, 2, 7), ('code-smell.goto', 'error', 15, 1, 9), ('code-smell.superglobals', 'warning', 15, 3, 5), ('code-smell.identical-subexpression', 'warning', 15, 5, 16), "
    "('security.sql-injection', 'error', 60, 4, 2), ('security.xss', 'error', 45, 4, 7), ('security.command-injection', 'error', 60, 1, 13), ('security.sensitive-parameter', 'warning', 10, 1, 3)) t(rule, severity, minutes, findings, first_line)",
    "golden_directives": _sql(
        "kind, line, selector, reason, warning, error, malformed",
        "'file', 3, 'complexity', 'old code', '', '', ''", "'symbol', 4, 'size.method-count', 'on purpose', '', '', ''", "'next-line', 6, 'code-smell.exit', '', '', '', ''",
        "'threshold', 8, 'complexity.cyclomatic', '', '5', '9', 'false'", "'threshold', 10, 'design.noc', '', '', '', 'true'", "'threshold', 12, 'maintainability.index', '', '30', '30', 'false'",
    ),
    "golden_bindings": _sql("line, subject_key, scope_rank", "3, NULL, NULL", "4, 'Notes\\A', 1", "6, 'Notes\\A::f', 2", "8, 'Notes\\A::g', 2", "10, 'Notes\\A::h', 2", "12, 'Notes\\A::i', 2"),
    "golden_coverage": _sql(
        "file, status", "'src/Math.php', 'analysed'", "'src/Shop/Cart.php', 'analysed'", "'src/Shop/Model.php', 'analysed'", "'src/Bad.php', 'analysed'", "'src/Unsafe.php', 'analysed'", "'src/Notes.php', 'analysed'", "'src/Plain.php', 'analysed'",
        "'src/Cut.php', 'failed'", "'src/Open.php', 'failed'", "'src/Made.php', 'generated'",
    ),
    "golden_rules": """WITH r AS (SELECT * FROM (VALUES ('complexity.cyclomatic', 'complexity.cyclomatic.callable', 10, 20, 30), ('complexity.cyclomatic', 'complexity.cyclomatic.class', 30, 50, 30), ('complexity.cognitive', 'complexity.cognitive.callable', 15, 30, 30),
('complexity.cognitive', 'complexity.cognitive.class', 30, 50, 30), ('complexity.npath', 'complexity.npath.callable', 200, 1000, 30), ('complexity.wmc', 'complexity.wmc', 50, 80, 30), ('maintainability.index', 'maintainability.index', 40, 20, 60), ('cohesion.lcom', 'cohesion.lcom', 3, 5, 45),
('coupling.cbo', 'coupling.cbo.class', 14, 20, 45), ('coupling.cbo', 'coupling.cbo.namespace', 14, 20, 45), ('coupling.instability', 'coupling.instability.class', 0.8, 0.95, 30), ('coupling.instability', 'coupling.instability.namespace', 0.8, 0.95, 30),
('coupling.distance', 'coupling.distance', 0.3, 0.5, 30), ('design.inheritance', 'design.inheritance', 4, 6, 30), ('design.noc', 'design.noc', 10, 15, 20), ('design.type-coverage', 'design.type-coverage.param', 80, 50, 15), ('design.type-coverage', 'design.type-coverage.return', 80, 50, 15),
('design.type-coverage', 'design.type-coverage.property', 80, 50, 15), ('size.method-count', 'size.method-count', 20, 30, 20), ('size.class-count', 'size.class-count', 15, 25, 30), ('size.property-count', 'size.property-count', 15, 20, 15),
('code-smell.long-parameter-list', 'code-smell.long-parameter-list', 4, 6, 20), ('code-smell.long-parameter-list', 'code-smell.long-parameter-list.vo', 8, 12, 20), ('code-smell.constructor-overinjection', 'code-smell.constructor-overinjection', 8, 12, 60),
('code-smell.unreachable-code', 'code-smell.unreachable-code', 1, 2, 10), ('code-smell.unused-private', 'code-smell.unused-private', 1, NULL, 15), ('duplication.code-duplication', 'duplication.code-duplication', 5, 50, 15), ('architecture.circular-dependency', 'architecture.circular-dependency', 2, NULL, 120)) t(rule, code, w, e, minutes))
SELECT rule || '#' || code AS channel, code || ' warning' AS subject_key, 'warning' AS severity, w::DOUBLE AS threshold, minutes FROM r UNION ALL SELECT rule || '#' || code, code || ' error', 'error', e::DOUBLE, minutes FROM r WHERE e IS NOT NULL""",
    "golden_gates": _sql(
        "channel, subject_key, severity, value, threshold",
        "'cohesion.lcom#cohesion.lcom', 'plain', 'error', 9, 5", "'size.property-count#size.property-count', 'plain', 'error', 99, 20", "'coupling.cbo#coupling.cbo.class', 'plain', 'error', 99, 20", "'coupling.cbo#coupling.cbo.class', 'readonly', 'error', 99, 20",
        "'coupling.cbo#coupling.cbo.class', 'unknown', 'warning', 14, 14", "'coupling.instability#coupling.instability.class', 'plain', 'error', 1, 0.95", "'maintainability.index#maintainability.index', 'plain', 'error', 5, 20",
        "'code-smell.long-parameter-list#code-smell.long-parameter-list', 'plain', 'error', 7, 6", "'code-smell.long-parameter-list#code-smell.long-parameter-list.vo', 'promoted', 'error', 12, 12",
        doubles="value, threshold",
    ),
    "golden_god_classes": _sql("subject_key, matched, evaluable, severity", "'all four', 4, 4, 'error'", "'three of four', 3, 4, 'warning'", "'three known', 3, 3, 'error'"),
    "golden_data_classes": _sql("subject_key, severity", "'data', 'warning'", "'unknown', 'warning'"),
    "golden_rank_findings": _sql("class, severity", "'C0', 'error'", "'C1', 'warning'"),
    "golden_computed": _sql(
        "channel, subject_key, severity, value, threshold", "'computed#health.cohesion', 'a', 'warning', 49.9, 50", "'computed#health.cohesion', 'c', 'error', 20, 25", "'computed#computed.risk', 'b', 'warning', 11, 10", "'computed#computed.risk', 'c', 'error', 30, 20",
        doubles="value, threshold",
    ),
    "golden_diagnoses": "SELECT directive_id, 'annotation.' || code || '#annotation.' || code AS channel, reason FROM (VALUES (2, 'unresolved-directive', 'unresolved'), (3, 'unsupported-threshold', 'no thresholds'), (4, 'invalid-threshold', 'malformed'), "
    "(5, 'invalid-threshold', 'error milder than warning'), (7, 'invalid-threshold', 'error milder than warning'), (8, 'invalid-threshold', 'negative'), (9, 'invalid-threshold', 'only warns'), (12, 'unused-directive', 'unused')) t(directive_id, code, reason)",
    "golden_sensitive_names": _sql("name", "'password'", "'userPassword'", "'apiKey'", "'API_KEY'", "'accessToken'", "'oldPasswd'", "'credentials'", "'dbPwd'"),
    "golden_baseline_roundtrip": _sql(
        "identity_key, magnitudes, count, inert", "'A::f|complexity#ccn|||', '12.0 25.0', 2, NULL", "'A|layer#edge||B|new', NULL, 1, NULL", "'A|layer#edge||C|extends', NULL, 1, NULL", "'file:src/b.php|smell#exit|exit||', NULL, 1, NULL", "'B::g|mi#mi|||', '38.0', 1, NULL",
    ),
    "golden_baseline_judged": _sql(
        "identity_key, verdict, outcome, count", "'A::f|complexity#ccn|||', 'within', 'updated', 1", "'A|layer#edge||B|new', 'within', 'updated', 1", "'A|layer#edge||C|extends', 'stale', 'untouched', 1", "'file:src/b.php|smell#exit|exit||', 'stale', 'untouched', 1", "'B::g|mi#mi|||', 'breach', 'refused', 1",
    ),
    "golden_baseline_cleaned": _sql("identity_key, reason", "'A|layer#edge||C|extends', 'stale'", "'file:src/b.php|smell#exit|exit||', 'undeclared'"),
    "golden_baseline_applied": _sql("channel, value, severity, verdict, accepted", "'complexity#ccn', 12, 'warning', 'within', '12.0 25.0'", "'complexity#ccn', 25, 'error', 'within', '12.0 25.0'", "'mi#mi', 38, 'error', 'breach', '38.0'", doubles="value"),
    "golden_baseline_explained": _sql(
        "subject_key, channel, boundary, source", "'A::f', 'complexity#ccn', 25, 'baseline'", "'A::f', 'mi#mi', 20, 'config'", "'B::g', 'complexity#ccn', 20, 'config'", "'B::g', 'mi#mi', 15, 'inline'", "'C::h', 'complexity#ccn', 20, 'config'", "'C::h', 'mi#mi', 20, 'config'",
        doubles="boundary",
    ),
    "golden_baseline_migrated": _sql("identity_key, count, reason", "'A::f|complexity#complexity|||', 2, NULL", "'A::t|size#size|||', 1, 'ambiguous symbol'", "'|size#size|||', 1, 'unknown symbol'"),
    "golden_scope": _sql("path", "'srcs'", "'lib'"),
    "golden_excluded": _sql("channel, subject_key", "'layer#edge', 'A'", "'layer#edge', 'A'", "'mi#mi', 'B::g'"),
    "golden_selected": "WITH c AS (SELECT unnest(['complexity.cyclomatic#complexity.cyclomatic.callable', 'complexity.cyclomatic#complexity.cyclomatic.class', 'complexity.wmc#complexity.wmc', 'size.method-count#size.method-count', 'size#size']) AS channel) "
    "SELECT 'all' AS gate, channel FROM c UNION ALL SELECT 'family', channel FROM c WHERE channel LIKE 'complexity.%' UNION ALL SELECT 'below', channel FROM c WHERE channel LIKE 'size.m%' UNION ALL SELECT 'pair', channel FROM c WHERE channel LIKE '%wmc' "
    "UNION ALL SELECT 'without', channel FROM c WHERE channel LIKE 'complexity.%' AND channel NOT LIKE '%class'",
    "golden_contributions": _sql(
        "namespace, ccn_sum, ccn_avg, ccn_count, loc_sum", "'A', 9, 3, 3, 30", "'A\\B', 4, 2, 2, 10", "'C', 7, 7, 1, 6", "'D', NULL, NULL, NULL, 40", "'D\\E', NULL, NULL, NULL, 40", doubles="ccn_sum, ccn_avg"
    ),
    "golden_runs": "SELECT 2 AS measures, 2.0::DOUBLE AS repeated, 5 AS findings, 9.0::DOUBLE AS seconds, false AS complete",
    "golden_new_files": _sql("file", "'b.php'", "'empty.php'"),
    # weights .35 .25 .25 over .85
    "golden_weights": "SELECT 'all' AS subject_key, round((.35 * 80 + .25 * 60 + .25 * 40) / .85, 6)::DOUBLE AS overall UNION ALL SELECT 'missing', round((.35 * 80 + .5 * 75) / .85, 6)::DOUBLE",
    "golden_duplication": _sql("tokens, places", "12, 'a:1 a:15 b:1'"),
    "golden_tokens": _sql("file, tokens, lines", "'a', '$_ = ''_'' . 0 ; f ( ''_'' $_ )', '2 2 2 2 3 3 5 5 5 5 5'", "'b', '', ''"),
    # 6 statements of 7 tokens; the two tables are equal too, but nothing else than constants
    "golden_verified": _sql("a_file, a_pos, b_file, b_pos, tokens, lines", "'a', 0, 'b', 0, 42, 6"),
    "golden_merged": _sql("subject_key, metric, value", "'s', 'ccn', 2", "'s', 'loc', 5", "'t', 'ccn', 7", doubles="value"),
    "golden_verdicts": _sql(
        "found, fail_on, exit_code", "'nothing', 'error', 0", "'nothing', 'warning', 0", "'nothing', 'none', 0", "'warning', 'error', 0", "'warning', 'warning', 1", "'warning', 'none', 0", "'error', 'error', 2", "'error', 'warning', 2", "'error', 'none', 0",
        "'config', 'error', 2", "'config', 'warning', 2", "'config', 'none', 2", "'cut short', 'error', 4",
    ),
}

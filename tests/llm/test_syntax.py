import ast
import itertools
import json
import re
from xml.parsers import expat

import pytest

from codestrata.llm.gll import Grammar
from codestrata.llm.syntax import check_syntax, parse, rates


def test_any_context_free_grammar():
    g = Grammar("s : s s | 'a' | ; p : '(' p ')' p | ; e : e '+' e | e '*' e | 'a' ; n : x* 'b' ; x : y? 'a'? ; y : 'c'? ; pal : 'a' pal 'a' | 'b' pal 'b' | 'a' | 'b' | ;")
    for n in range(7):
        for t in itertools.product("ab", repeat=n):
            assert bool(g.accepts(list(t), "pal")) == (t == t[::-1])
            assert bool(g.accepts(list(t), "s")) == ("b" not in t)
        for t in itertools.product("a+*", repeat=n):
            assert bool(g.accepts(list(t), "e")) == bool(re.fullmatch(r"a([+*]a)*", "".join(t)))
        for t in itertools.product("abc", repeat=min(n, 5)):
            assert bool(g.accepts(list(t), "n")) == bool(re.fullmatch("[ac]*b", "".join(t)))
        for t in itertools.product("()", repeat=n):
            depth = list(itertools.accumulate((1 if c == "(" else -1 for c in t), initial=0))
            assert bool(g.accepts(list(t), "p")) == (min(depth) >= 0 and depth[-1] == 0)


def test_dialects_share_one_stack():
    # old: words of a; mid: also b after the first letter; new: anything, doubly ambiguous
    g = Grammar("w : x w | ; x : 'a' | @mid 'a' 'b' | @new y | @new 'b' ; y : 'a' | 'b' 'b' | y y ;", ("old", "mid", "new"))
    for n in range(8):
        for t in itertools.product("ab", repeat=n):
            word = "".join(t)
            expected = [d for d, p in (("old", "a*"), ("mid", "(ab?)*"), ("new", "[ab]*")) if re.fullmatch(p, word)]
            assert list(g.accepts(list(t), "w")) == expected, word


def _python(t):
    try:
        ast.parse(t)
        return True
    except (SyntaxError, ValueError):
        return False


def _json(t):
    try:
        json.loads(t, parse_constant=lambda c: 1 / 0)
        return True
    except (ValueError, ZeroDivisionError):
        return False


def _xml(t):
    try:
        expat.ParserCreate().Parse(t.encode(), True)
        return True
    except expat.ExpatError:
        return False


PYTHON = """
import a.b as c, d
from . import (x, y as z,)
@dec(1)
async def f(a, /, b: int = 1, *args: T, c, **kw) -> None:
    async with a as b, c: pass
    return await x if y else lambda q, *r: (yield)
class A[T](B, metaclass=C):
    x: int = 3; y = z = [i async for i in j if i if not k]
    def g(self): nonlocal_ = {**a, 'b': 1} | {1, *s}; print(f"{x!r:>{w}} {y=}", *a, k=1, **b)
match point:
    case Point(x=0, y=[1, *_]) | {"a": b, **c} if b: pass
    case -1 | "s" as t: match = 3; case = match[1:2, ::3, ...]
try: pass
except* (A, B) as e: raise X from None
else: del a, b[0]
while (n := f()) and not a is not b in c: continue
type X = int
a, *b = c = yield_ = *d, e
x @= y ** -z // ~w << 2
with (open(a) as f, open(b)): ...
assert x, "m"
"""


@pytest.mark.parametrize("language,text,known", [("python", PYTHON, _python), ("json", '{"a": [1, -2.5e3, true, null, "\\u00e9\\n"], "b": {}}', _json), ("xml", '<?xml version="1.0"?>\n<!DOCTYPE a [<!ENTITY e "x">]><!-- c --><a b="1" c=\'&e;&#65;\'><?pi x?><b/>t &amp; &lt;<![CDATA[<&]]></a>\n', _xml)])
def test_like_the_languages_own_parsers(language, text, known):
    """The text, each of its prefixes, and the text without each of its characters."""
    step = 3 if language == "python" else 1
    begin = 22 if language == "xml" else 0  # the other XML parser takes any version number
    for i in range(begin, len(text) + 1, step):
        for t in (text[:i], text[:i] + text[i + 1 :]):
            if t.strip():
                assert bool(parse(t, language)[0]) == known(t), t


GOOD_PHP = [
    "<?php\ndeclare(strict_types=1);\nnamespace A\\B;\nuse C\\{D, E as F};\nuse function g\\h;\nfinal readonly class X extends Y implements Z, W { use T { T::a insteadof U; b as protected c; } const int A = 1, B = self::A . 'x'; public private(set) ?int $p = 1 { get => $this->p; set(int $v) { $this->p = $v; } } function __construct(private readonly A|(B&C)|null $x = new D(), int ...$r) {} abstract static function list(): static; }",
    "<?php enum S: string implements I { case A = 'a'; const X = self::A; public static function f(): self { return self::A; } }",
    "<?php $a = match(true) { $x > 1, $y => 'a', default => throw new E(), }; $f = fn(int $x): int => $x ** 2; $g = static function &(array $a) use (&$b, $c): ?string { yield $k => $v; yield from f(); }; [$a, [, $b], 'k' => $c] = $d; list($a, list($b)) = $c; $x = $a?->b?->c()['d']::E ?? 5; $o = new class(1) extends A { public $x; }; foo(...); foo(name: 1, ...$rest);",
    "<?php if ($a): ?>\n<b><?= $x ?></b>\n<?php elseif ($b): echo 1; else: ?> x <?php endif; foreach ($a as $k => [$x, $y]): endforeach; for (;;): break; endfor; switch ($a): case 1: default: endswitch; while (1): endwhile ?>",
    "<?php echo \"a {$b['c']} ${d} $e[0] $f->g {$h->i('j')} \\$x {no}\"; echo <<<EOT\n  x {$a} ' \" (\n  EOT . <<<'N'\n<<<<<<< ours {$\nN;\n`ls $x`; #[Attr(1), B] function f() {} // c ?> <?php\n# d\n/* e */ goto end; end: exit; __halt_compiler(); {{ raw (",
    "just html without end <?= 1 ?>", "<?php", "<?php interface I extends A, B { const X = 1; function f(); } trait T { abstract private function g(); } abstract class C { public static ?A $x = null, $y; } try { } catch (A|B) { } finally { } do { } while (0); $a <=> $b and $c xor !$d; print $x; static $s = 1; global $g; unset($a, $b[1]); $x instanceof A; clone $x; (int) $y; @$z; $$v; $o->{'x'}(); A::$b; A::{$c}();",
]
BAD_PHP = [
    "no tag at all", "<? echo 1;", "<?php class A {", "<?php function f( {}", "<?php $x = ;", "<?php echo 'open;", "<?php /* open", "<?php\n<<<<<<< ours\n$a = 1;\n=======\n$a = 2;\n>>>>>>> theirs\n", "<?php foo(", "<?php $a = [1, 2;",
    "<?php class A { $x; }", "<?php 1 = 2;", "<?php if ($a) { ?> x", "<?php echo \"{$a\";", "<?php echo <<<EOT\nx\n", "<?php match($a) { 1 => };", "<?php try { }", "<?php }", "def f(x):\n    return x", "<?php $a->;", "<?php use A\\{;",
]


def test_php():
    assert [t for t in GOOD_PHP if not parse(t, "php")[0]] == []
    assert [t for t in BAD_PHP if parse(t, "php")[0]] == []


GOOD_YAML = ["a: 1\nb:\n  - x\n  - y: {c: d, e: [1, 2]}\n", "- a\n-\n  - b\n", "%YAML 1.1\n---\na: &x 1\nb: *x\n...\n---\n- !t z\n", "t: |\n  <<<<<<< x\n   { [\n  b\nu: >-\n  folded\n", "'a b': \"c\\n\\u00e9\"\n? complex\n: value\n", "plain text\n", "# only\n", "a: b: c" * 0 + "k: v # c\n", "k:\n- a\n- b\n"]
BAD_YAML = ["a: [1, 2", "a: 'x", "a: b: c\n", "a:\n  - b\n c: d\n", "\ta: 1\n", "a: {b", "- a\nb: c\n", "a: *\n", "x: @y\n", "a: 1\n<<<<<<< ours\nb: 2\n", "k: \"\\q\"\n", "a: ]\n"]


BAD_CHAINS = ["$a == $b == $c", "$a < $b < $c", "$a === $b + 1 != $c", "$a == $b < $c == $d", "$a ? 1 : $b ? 2 : 3", "$a ?: $b ? 2 : 3", "$a ? 1 : $b ?: 3", "$a = &new A", "$a = &new A($b)", "(unset)$y", "( real ) $y", "f($a == $b == $c)"]
GOOD_CHAINS = [
    "$a == $b && $c == $d", "$a < $b == $c < $d", "$a == ($b == $c)", "$a == $b = $c == $d", "$a ? 1 : ($b ? 2 : 3)", "$a ? $b ? 1 : 2 : 3", "$a ?: $b ?: $c", "$x = $a ? 1 : 2 and $b ? 1 : 2",
    "[$a == 1, $b == 2]", "$a = &$b", "$a = &f()", "$a = & $b->c[1]", "$f = fn(?int $a): ?int => $a ? 1 : 2", "match($a == $b) { $c == $d, $e == $f => $g == $h }", "$a == $b ? $c == $d : $e == $f", "$a == $b ?? $c == $d",
    "$a . '<' . $b < $c", "$f = function(?A $x): ?B { return $x == 1 ? 2 : 3; }", "$a == print $b == $c",
]


def test_php_chains():
    assert [t for t in GOOD_CHAINS if not parse(f"<?php {t};", "php")[0]] == []
    assert [t for t in BAD_CHAINS if parse(f"<?php {t};", "php")[0]] == []


def test_dialects_of_files():
    of = lambda t, language: parse(t, language)[0]
    assert of("<?php class A { public $x; }", "php") == ("7.4", "8.0", "8.1", "8.2", "8.3", "8.4")
    assert of("<?php $x = match($a) { 1 => 2 };", "php")[0] == "8.0" and of("<?php enum A { case B; }", "php")[0] == "8.1"
    assert of("<?php readonly class A {}", "php")[0] == "8.2" and of("<?php class A { const int B = 1; }", "php")[0] == "8.3"
    assert of("<?php class A { public int $x { get => 1; } }", "php") == ("8.4",) and of("<?php try {} catch (A) {}", "php")[0] == "8.0"
    assert of("x = 1\n", "python")[0] == "3.7" and of("if (n := 1): pass\n", "python")[0] == "3.8" and of("type X = int\n", "python") == ("3.12", "3.13")
    assert of("match x:\n  case 1: pass\n", "python")[0] == "3.10" and of("try: pass\nexcept* A: pass\n", "python")[0] == "3.11"
    assert of("<a/>", "xml") == ("standalone", "external") and of("<!DOCTYPE a SYSTEM 'x.dtd'><a>&e;</a>", "xml") == ("external",)


PYTHON_LITERALS = [
    "0777", "00", "0_0", "0o17", "0o8", "1_000", "1__0", "1_", "0x_f", "0b12", "1e5", "1e", "1.e3j", ".5", "012.5", "09e1", "07j", "1if 1else 2", "0xfor x in y", r"'\x1'", r"'\x41'", r"b'\x1'", r"r'\x1'", r"'\u12'",
    r"b'\u12'", r"'\U00110000'", r"'\U0001F600'", r"'\N{foo}'", r"'\N{DIGIT ONE}'", r"'\N'", r"b'\N{foo}'", "b'\u00e9'", "b'a' 'b'", "b'a' b'b'", "'a' f'b'", "b'a' f'b'", r"f'\x1'", r"rf'\x1'", r"f'\N{DIGIT ONE}{x}'", r"f'{x}\u1'",
    r"'\8'", r"'\\x1'", r"f'{x:\x41}'", "f'{x!r}' 'y'", "u'a'", "ur'a'",
]


@pytest.mark.filterwarnings("ignore")
def test_python_literals():
    assert [t for t in PYTHON_LITERALS if bool(parse(f"x = {t}\n", "python")[0]) != _python(f"x = {t}\n")] == []


XML_PROLOGUES = [
    "<!ENTITY e '<b>'>", "<!ENTITY e '<b/>'>", "<!ENTITY e '<b></c>'>", "<!ENTITY e '&e;'>", "<!ENTITY e '&f;'><!ENTITY f '&e;'>", "<!ENTITY e '&f;'><!ENTITY f 'x'>", "<!ENTITY e '&#60;b>'>", "<!ENTITY e '&#38;#60;'>",
    "<!ENTITY e '&'>", "<!ENTITY e '%p;'>", "<!ENTITY e '&#0;'>", "<!ENTITY e 'x'><!ELEMENT a>", "<!ENTITY e 'x'><!ELEMENT a EMPTY>", "<!ENTITY e 'x'><!ELEMENT a (b,c?,(d|e)*)+>", "<!ENTITY e 'x'><!ELEMENT a (b,c|d)>",
    "<!ENTITY e 'x'><!ELEMENT a (#PCDATA)>", "<!ENTITY e 'x'><!ELEMENT a (#PCDATA|b)*>", "<!ENTITY e 'x'><!ELEMENT a (#PCDATA|b)>", "<!ENTITY e 'x'><!ATTLIST a b foo>", "<!ENTITY e 'x'><!ATTLIST a b CDATA #IMPLIED>",
    "<!ENTITY e 'x'><!ATTLIST a b (x|y) 'x' c ID #REQUIRED>", "<!ENTITY e 'x'><!ATTLIST a b CDATA '<'>", "<!ENTITY e 'x'><!ATTLIST a>", "<!ENTITY e SYSTEM 'x'>", "<!ENTITY e SYSTEM 'x' NDATA n>", "<!ENTITY f 'x'>", "<!ENTITY e ''>",
    "<!ENTITY e 'x]]>y'>", "<!ENTITY e '<!-- c --><?p x?>'>", "<!ENTITY e '<![CDATA[<]]>'>", "<!ENTITY e '<b c=\"&f;\"/>'><!ENTITY f '&#60;'>",
]


@pytest.mark.parametrize("use", ["<a>&e;</a>", "<a b='&e;'/>", "<a/>"])
def test_xml_declarations(use):
    for p in XML_PROLOGUES:
        text = f"<!DOCTYPE a [{p}]>{use}"
        assert bool(parse(text, "xml")[0]) == _xml(text), text


@pytest.mark.parametrize("text", ["<!DOCTYPE a SYSTEM 'x'><a>&e;</a>", "<?xml version='1.0' standalone='yes'?><!DOCTYPE a SYSTEM 'x'><a>&e;</a>", "<!DOCTYPE a [%p;]><a>&e;</a>", "<!DOCTYPE a [<!ENTITY % p SYSTEM 'x'> %p;]><a b='&e;'/>", "<!DOCTYPE a []><a>&e;</a>", "<a>&e;</a>"])
def test_entities_that_may_be_declared_outside(text):
    assert bool(parse(text, "xml")[0]) == _xml(text)


YAML_PROBES = [
    "{: a}", "[: a]", "{a: b, : c}", "? a\n: b\n", ": b\n", "a: 1\n: 2\n", "- : b", "{? a : b}", "[? a : b]", "%YAML 1.2\n---\na", "%YAML 2.0\n---\na", "%FOO x\n---\na", "%TAG !x! y\n---\n!x!b c", "%TAG !\n---\na", "!x!y a", "!!str a",
    "%YAML 1.1\n%YAML 1.1\n---\na", "%TAG !x! y\n---\n!x!b c\n---\n!x!b c", "a: !<x> b", "--- |\n x\n--- >\n y\n", "{\"a\":b}", "[a,b]:c", "%YAML 1.1 # c\n---\na", "%YAML 1.1 x\n---\na",
]


def test_yaml_like_a_public_parser():
    yaml = pytest.importorskip("yaml")

    def known(t):
        try:
            return bool(list(yaml.parse(t, Loader=yaml.SafeLoader)))
        except yaml.YAMLError:
            return False

    assert [t for t in YAML_PROBES if bool(parse(t, "yaml")[0]) != known(t)] == []


def test_yaml():
    assert [t for t in GOOD_YAML if not parse(t, "yaml")[0]] == []
    assert [t for t in BAD_YAML if parse(t, "yaml")[0]] == []


def test_table(spark):
    rows = [
        (1, "A.JSON", "{}", "r"), (2, "b/c.json.dist", "{", "r"), (3, "x.py", "def f(:", None), (4, "x.txt", "(((", "r"), (5, None, "{", "r"), (6, "y.py", None, "r"), (7, "y.py", " \n\u00a0", "r"),
        (8, "z.Php", "<?php f();", "r"), (9, "z.inc", "no tag", "r"), (10, "a\\b.yml", "a: 1", "s"), (2, "b/c.json.dist", "{", "r"), (11, "q.xml.dist", "<a/>", "s"),
    ]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, path string, text string, repo string, valid string")
    got = check_syntax(docs)
    assert {tuple(r.dialects) for r in got.where("doc_id = 1").collect()} == {("rfc8259",)} and all(r.valid == bool(r.dialects) for r in got.collect())
    assert sorted((r.doc_id, r.valid) for r in got.collect()) == [(1, True), (2, False), (2, False), (3, False), (8, True), (9, False), (10, True), (11, True)]
    assert check_syntax(docs.limit(0)).count() == 0
    unique = docs.dropDuplicates(["doc_id"])
    assert {(r.repo, r.language, r.files, r.invalid, r.rate) for r in rates(check_syntax(unique, keep=["repo"])).collect()} == {("r", "json", 2, 1, 0.5), (None, "python", 1, 1, 1.0), ("r", "php", 2, 1, 0.5), ("s", "yaml", 1, 0, 0.0), ("s", "xml", 1, 0, 0.0)}


def test_mutations_like_the_languages_own_parsers():
    import random

    rng = random.Random(7)
    for language, text, known in (("python", PYTHON, _python), ("json", '{"a": [1, -2.5e3, true], "b\\u00e9": {"c": null}}', _json), ("xml", '<r a="1">t &amp;<b c=\'&#65;\'/><![CDATA[<]]><?p q?><!-- c --></r>', _xml)):
        for _ in range(300):
            s = list(text)
            for _ in range(rng.choice([1, 1, 2])):
                i = rng.randrange(len(s))
                s[i : i + rng.randrange(2)] = rng.choice(["", *"\n \t'\"(){}[]<>&;:,.=*\\#@0_1eb-+!|?"])
            t = "".join(s)
            if t.strip():
                assert bool(parse(t, language)[0]) == known(t), t


def test_long_texts_are_read_whole():
    assert parse("[" + "1," * 200_000 + "2]", "json")[0] and not parse("[" + "1," * 200_000 + "2", "json")[0]
    assert parse("[" * 50_000 + "]" * 50_000, "json")[0]

"""User formulas over metrics, compiled to Spark expressions.

Formulas know numbers, 'strings', [lists], variables (a dot in a metric's name is written `__`), `+ - * / % **`,
comparisons, `&& || !` (also and, or, not), `in`, `matches`, `a ? b : c`, `a ?: c`, `a ?? b`, and the functions min max
abs sqrt log log10 clamp. Division by zero, NaN and infinities make a metric absent.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|("[^"]*"|'[^']*')|(\?\?|\?:|\*\*|&&|\|\||==|!=|<=|>=|[-+*/%<>!?:(),\[\]])|([A-Za-z_]\w*))""")
_LEVELS = [("??",), ("||", "or"), ("&&", "and"), ("==", "!=", "<", ">", "<=", ">=", "in", "matches"), ("+", "-"), ("*", "/", "%")]
FUNCTIONS = ("min", "max", "abs", "sqrt", "log", "log10", "clamp")


class FormulaError(ValueError):
    pass


class _Parser:
    """Builds a tree: ('num', x) ('str', s) ('var', n) ('list', [..]) ('call', f, [..]) ('op', o, a, b) ('not'|'neg', a) ('if', c, a, b)."""

    def __init__(self, text: str) -> None:
        self.words: list[tuple[str, str]] = []
        pos, text = 0, text.strip()
        while pos < len(text):
            m = _TOKEN.match(text, pos)
            if m is None:
                raise FormulaError(f"unexpected {text[pos:pos + 10]!r}")
            kind = ("num", "str", "op", "name")[m.lastindex - 1]
            self.words.append((kind, m.group(m.lastindex)))
            pos = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.words[self.at][1] if self.at < len(self.words) and self.words[self.at][0] in ("op", "name") else ""

    def take(self, want: str) -> None:
        if self.peek() != want:
            raise FormulaError(f"expected {want!r}")
        self.at += 1

    def whole(self):
        tree = self.ternary()
        if self.at != len(self.words):
            raise FormulaError(f"unexpected {self.words[self.at][1]!r}")
        return tree

    def ternary(self):
        cond = self.binary(0)
        if self.peek() == "?:":
            self.at += 1
            return ("if", cond, cond, self.ternary())
        if self.peek() == "?":
            self.at += 1
            a = self.ternary()
            self.take(":")
            return ("if", cond, a, self.ternary())
        return cond

    def binary(self, level: int):
        if level == len(_LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while (o := self.peek()) in _LEVELS[level]:
            self.at += 1
            right = self.binary(level if o == "??" else level + 1)
            left = ("op", o, left, right)
        return left

    def unary(self):
        if self.peek() in ("!", "not"):
            self.at += 1
            return ("not", self.unary())
        if self.peek() in ("-", "+"):
            sign = self.peek()
            self.at += 1
            inner = self.unary()
            return ("neg", inner) if sign == "-" else inner
        base = self.primary()
        if self.peek() == "**":
            self.at += 1
            return ("op", "**", base, self.unary())
        return base

    def listed(self, close: str) -> list:
        out = []
        while self.peek() != close:
            out.append(self.ternary())
            if self.peek() == ",":
                self.at += 1
            elif self.peek() != close:
                raise FormulaError(f"expected {close!r}")
        self.at += 1
        return out

    def primary(self):
        if self.at >= len(self.words):
            raise FormulaError("unexpected end")
        kind, word = self.words[self.at]
        self.at += 1
        if kind == "num":
            return ("num", float(word))
        if kind == "str":
            return ("str", word[1:-1])
        if word == "(":
            inner = self.ternary()
            self.take(")")
            return inner
        if word == "[":
            return ("list", self.listed("]"))
        if kind != "name":
            raise FormulaError(f"unexpected {word!r}")
        if self.peek() == "(":
            if word not in FUNCTIONS:
                raise FormulaError(f"unknown function {word!r}")
            self.at += 1
            return ("call", word, self.listed(")"))
        return ("var", word)


def parse(text: str):
    return _Parser(text).whole()


def variables(tree, guarded: bool = False) -> dict[str, bool]:
    """Variables of a formula; whether each is guarded by ?? wherever it stands."""
    out: dict[str, bool] = {}

    def add(more: dict[str, bool]) -> None:
        for k, v in more.items():
            out[k] = out.get(k, True) and v

    if tree[0] == "var":
        return {tree[1]: guarded}
    if tree[0] == "op":
        add(variables(tree[2], guarded or tree[1] == "??"))
        add(variables(tree[3], guarded))
    elif tree[0] in ("list", "call"):
        for t in tree[-1]:
            add(variables(t, guarded))
    elif tree[0] in ("not", "neg", "if"):
        for t in tree[1:]:
            add(variables(t, guarded))
    return out


def compile_formula(text: str, columns: set[str]) -> Column:
    """The formula as a column of doubles; variables that aren't columns are null. null where the result isn't finite."""
    value = _column(parse(text), columns).cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def _column(tree, columns: set[str]) -> Column:
    kind = tree[0]
    sub = lambda t: _column(t, columns)
    if kind in ("num", "str"):
        return F.lit(tree[1])
    if kind == "var":
        return F.col(f"`{tree[1]}`").cast("double") if tree[1] in columns else F.lit(None).cast("double")
    if kind == "neg":
        return -sub(tree[1])
    if kind == "not":
        return ~sub(tree[1]).cast("boolean")
    if kind == "if":
        return F.when(sub(tree[1]).cast("boolean"), sub(tree[2])).otherwise(sub(tree[3]))
    if kind == "list":
        return F.array(*map(sub, tree[1]))
    if kind == "call":
        args = [sub(t) for t in tree[2]]
        if tree[1] in ("min", "max"):  # null makes null, where Spark would skip it
            pick = F.least if tree[1] == "min" else F.greatest
            none = args[0].isNull()
            for a in args[1:]:
                none = none | a.isNull()
            return F.when(~none, pick(*args) if len(args) > 1 else args[0])
        if tree[1] == "clamp":
            return F.when(args[0].isNotNull(), F.greatest(args[1], F.least(args[2], args[0])))
        return {"abs": F.abs, "sqrt": F.sqrt, "log": F.ln, "log10": F.log10}[tree[1]](args[0])
    o, a, b = tree[1], tree[2], tree[3]
    if o == "in":
        return F.array_contains(sub(b), sub(a))
    if o == "matches":
        if b[0] != "str":
            raise FormulaError("matches needs a pattern")
        return sub(a).rlike(b[1].strip("/"))
    x, y = sub(a), sub(b)
    return {
        "??": lambda: F.coalesce(x, y), "||": lambda: x.cast("boolean") | y.cast("boolean"), "or": lambda: x.cast("boolean") | y.cast("boolean"),
        "&&": lambda: x.cast("boolean") & y.cast("boolean"), "and": lambda: x.cast("boolean") & y.cast("boolean"), "==": lambda: x == y, "!=": lambda: x != y,
        "<": lambda: x < y, ">": lambda: x > y, "<=": lambda: x <= y, ">=": lambda: x >= y, "+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y,
        "/": lambda: F.try_divide(x, y), "%": lambda: F.try_mod(x, y), "**": lambda: F.pow(x, y),
    }[o]()


def order(formulas: Mapping[str, str]) -> list[str]:
    """Names so that each comes after those that it uses; the order given, if there is a cycle."""
    uses = {n: {v.replace("__", ".") for v in variables(parse(f))} & set(formulas) - {n} for n, f in formulas.items()}
    try:
        sorter = TopologicalSorter(uses)
        return list(sorter.static_order())
    except CycleError:
        return list(formulas)


def unknown_variables(formulas: Mapping[str, str], columns: set[str]) -> dict[str, list[str]]:
    """Per formula the variables that are neither metrics nor formulas nor guarded by ??."""
    names = {n.replace(".", "__") for n in formulas}
    found = {n: sorted(v for v, ok in variables(parse(f)).items() if not ok and v not in columns and v not in names) for n, f in formulas.items()}
    return {n: v for n, v in found.items() if v}


def compute(subjects: DataFrame, formulas: Mapping[str, str]) -> DataFrame:
    """`subjects` (wide; dots in metric names written `__`) with a column per formula, in the order of their uses."""
    out = subjects
    for name in order(formulas):
        column = name.replace(".", "__")
        out = out.withColumn(column, compile_formula(formulas[name], set(out.columns)))
    return out


def without_dimension(formula_weights: Mapping[str, float], excluded: set[str]) -> dict[str, float]:
    """Weights of an overall score without some dimensions, brought back to a sum of 1."""
    kept = {k: w for k, w in formula_weights.items() if k not in excluded}
    whole = sum(kept.values())
    return {k: w / whole for k, w in kept.items()} if whole else {}


def overall(weights: Mapping[str, float], missing: float = 75) -> str:
    return "clamp(" + " + ".join(f"{w!r} * (health__{k} ?? {missing})" for k, w in weights.items()) + ", 0, 100)"


def _r(x: str, t: str) -> str:
    return f"max({x} - {t}, 0)"


# fixed values: the default health scores by level, and the thresholds (warning, error) below which they are findings
CLASS_WEIGHTS = {"complexity": 0.35, "cohesion": 0.25, "coupling": 0.25, "typing": 0.15}
GROUP_WEIGHTS = {"complexity": 0.30, "cohesion": 0.20, "coupling": 0.20, "typing": 0.10, "maintainability": 0.20}
HEALTH_THRESHOLDS = {"complexity": (50, 25), "cohesion": (50, 25), "coupling": (50, 25), "typing": (80, 50), "maintainability": (50, 25), "overall": (50, 30)}
_TCC = "(tcc ?? ((methodCount ?? 0) < 6 ? 0.5 : 0))"
_PURE = "(pureMethodCount ?? 0)"
HEALTH_CLASS = {
    "health.complexity": f"clamp(100 - 2 * {_r('(ccn__avg ?? 1)', '4')} - 2 * {_r('(cognitive__avg ?? 0)', '5')} - 2 * sqrt({_r('(ccn__max ?? 0)', '10')}) - 2 * sqrt({_r('(cognitive__max ?? 0)', '10')}), 0, 100)",
    "health.cohesion": f"clamp(50 * sqrt({_TCC} + (1 - {_TCC}) * 0.4 * {_PURE} / max(methodCount ?? 0, 1)) + 50 * (1 - clamp((max((lcom ?? 0) - 0.7 * {_PURE}, 1) - 1) / 5, 0, 1)), 0, 100)",
    "health.coupling": f"clamp(1500 / (15 + {_r('3 * (ce_packages ?? 0) + 0.5 * sqrt(ce ?? 0)', '5')}), 0, 100)",
    "health.typing": "clamp(typeCoverage__pct ?? 0, 0, 100)",
    "health.maintainability": f"clamp(100 - 1.5 * {_r('85', '(mi__avg ?? 75)')} - 3 * sqrt({_r('50', '(mi__min ?? 50)')}), 0, 100)",
    "health.overall": overall(CLASS_WEIGHTS),
}
_M = "max(symbolMethodCount ?? 0, 1)"
_GROUP = {
    "health.complexity": f"clamp(100 - 1.5 * {_r(f'(ccn__sum ?? 0) / {_M}', '3')} - 1.5 * {_r(f'(cognitive__sum ?? 0) / {_M}', '4')} - 3 * sqrt({_r('(ccn__p95 ?? 0)', '5')}) - 3 * sqrt({_r('(cognitive__p95 ?? 0)', '6')}) - 0.8 * sqrt({_r('(ccn__max ?? 0)', '20')}), 0, 100)",
    "health.cohesion": "clamp(50 * sqrt(tcc__avg ?? 0.5) + 50 * (1 - clamp(((lcom__avg ?? 0) - 1) / 5, 0, 1)), 0, 100)",
    "health.typing": "(typed_total__sum ?? 0) == 0 ? 100 : clamp(100 * (typed__sum ?? 0) / typed_total__sum, 0, 100)",
    "health.maintainability": f"clamp(100 - 2 * {_r('82', '(mi__avg ?? 75)')} - 4.5 * sqrt({_r('55', '(mi__p5 ?? 55)')}) - 1.5 * {_r('5', '(mi__min ?? 5)')} ** 0.4, 0, 100)",
    "health.overall": overall(GROUP_WEIGHTS),
}
HEALTH_NAMESPACE = _GROUP | {
    "health.coupling": f"clamp(1800 / (18 + 6 * (distance ?? 0) + 4 * {_r('3 * (ce_packages__avg ?? 0) + 0.5 * sqrt(ce__avg ?? 0)', '4')} + 0.8 * sqrt({_r('(ce__max ?? 0)', '30')}) + 0.6 * sqrt({_r('(ce ?? 0)', '50')})), 0, 100)"
}
HEALTH_PROJECT = _GROUP | {
    "health.coupling": f"clamp(1800 / (18 + 6 * (distance__avg ?? 0) + 3 * {_r('(cbo__avg ?? 0)', '8')} + 0.4 * {_r('(cbo__p95 ?? 0)', '15')} + 0.8 * sqrt({_r('(cbo__max ?? 0)', '30')})), 0, 100)"
}

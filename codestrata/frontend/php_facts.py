"""Measurements, dependency edges and findings' raw entries from PHP source text.

Statements are parsed into a tree, expressions stay spans of tokens; every measure is one walk over them. A file that
can't be read gives one row of kind `failure`. Rows: `kind` (file, class, callable, edge, entry, directive, failure),
`subject`, `owner`, `line`, `values` (map of numbers) and `extra` (map of texts).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from codestrata.frontend.php_lexer import Lexer
from codestrata.frontend.php_taint import injections, repeated

NPATH_MOST = 1e9  # fixed value: paths are counted up to here
_AND, _OR = ("&&", "and"), ("||", "or", "xor")
_TYPE_WORDS = frozenset("int float string bool array callable iterable object mixed void never null false true self static parent".split())
_MODIFIERS = ("public", "protected", "private", "static", "abstract", "final", "readonly", "var")
_CONTROL = frozenset("if elseif else for foreach while do switch case default break continue return throw try catch finally goto echo match new instanceof clone print yield".split())
_OPERATORS = frozenset("+ - * / % ** . = += -= *= /= .= %= **= &= |= ^= <<= >>= ??= == != <> === !== < > <= >= <=> && || ! & | ^ ~ << >> ++ -- ?? ? -> ?-> :: => @ [ (".split())
_OPERANDS = ("VAR", "INT", "FLOAT", "STR", "NAME", "QNAME", "ENC_VAR", "MAGIC")
_CLOSERS = {"(": ")", "[": "]", "{": "}", "#[": "]", "ENC_OPEN": "ENC_CLOSE", "DQ_OPEN": "DQ_CLOSE"}


@dataclass
class Statement:
    kind: str
    line: int
    spans: list = field(default_factory=list)  # expressions, each (from, to)
    bodies: list = field(default_factory=list)  # lists of statements
    tail: list | None = None  # else, default or finally


@dataclass
class Callable_:
    name: str
    owner: str
    kind: str
    line: int
    end_line: int
    parameters: list  # (name, type or '', promoted, line, marked as sensitive)
    returns: str
    body: list
    modifiers: tuple = ()
    span: tuple = (0, 0)


@dataclass
class Class_:
    name: str
    kind: str
    line: int
    end_line: int = 0
    modifiers: tuple = ()
    extends: list = field(default_factory=list)
    implements: list = field(default_factory=list)
    uses: list = field(default_factory=list)
    methods: list = field(default_factory=list)
    properties: list = field(default_factory=list)  # (name, visibility, type, static, readonly)
    constants: list = field(default_factory=list)


class Unreadable(Exception):
    pass


class Parser:
    def __init__(self, text: str) -> None:
        lexer = Lexer(text)
        self.toks = lexer.run()
        self.comments = lexer.comments
        if self.toks and self.toks[-1][0] == "BAD":
            raise Unreadable
        self.kinds = [t[0] for t in self.toks] + ["<end>"]
        self.namespace, self.imports = "", {}
        self.classes: list[Class_] = []
        self.callables: list[Callable_] = []
        self.edges: list[tuple[str, str, str, int]] = []
        self.stack: list[Class_] = []
        self.match_of = self._pairs()

    def _pairs(self) -> dict[int, int]:
        out, stack = {}, []
        for i, k in enumerate(self.kinds):
            if k in _CLOSERS:
                stack.append((i, _CLOSERS[k]))
            elif k in (")", "]", "}", "ENC_CLOSE", "DQ_CLOSE"):
                if not stack or stack[-1][1] != k:
                    raise Unreadable
                out[stack.pop()[0]] = i
        if stack:
            raise Unreadable
        return out

    def line(self, i: int) -> int:
        return self.toks[min(i, len(self.toks) - 1)][2] if self.toks else 1

    def resolve(self, name: str) -> str:
        low = name.lower()
        if name.startswith("\\"):
            return name[1:]
        head, _, rest = name.partition("\\")
        if head.lower() == "namespace":
            return f"{self.namespace}\\{rest}".strip("\\")
        if head.lower() in self.imports:
            return self.imports[head.lower()] + (f"\\{rest}" if rest else "")
        if low in _TYPE_WORDS:
            return ""
        return f"{self.namespace}\\{name}".strip("\\")

    def edge(self, name: str, kind: str, i: int) -> None:
        target = self.resolve(name)
        source = self.stack[-1].name if self.stack else ""
        if target and source and target != source:
            self.edges.append((source, target, kind, self.line(i)))

    # -- statements

    def file(self) -> list[Statement]:
        return self.statements(0, len(self.toks))

    def statements(self, i: int, end: int) -> list[Statement]:
        out = []
        while i < end:
            s, i = self.statement(i, end)
            if s is not None:
                out.append(s)
        return out

    def until(self, i: int, end: int, stops: tuple[str, ...]) -> int:
        while i < end and self.kinds[i] not in stops:
            i = self.match_of.get(i, i) + 1
        return i

    def body(self, i: int, end: int, closers: tuple[str, ...] = ()) -> tuple[list[Statement], int]:
        """A statement after a header, a braced block, or a `:` form up to one of `closers` (which isn't taken)."""
        if self.kinds[i] == ":" and closers:
            k = i + 1
            out: list[Statement] = []
            while k < end and self.kinds[k] not in closers:
                s, k = self.statement(k, end)
                if s is not None:
                    out.append(s)
            return out, k
        s, j = self.statement(i, end)
        return ([] if s is None else s.bodies[0] if s.kind == "block" else [s]), j

    def statement(self, i: int, end: int) -> tuple[Statement | None, int]:
        """The statement at `i` (None for what isn't executed) and where it ends; headers' closures are noted too."""
        s, j = self._statement(i, end)
        if s is not None and s.kind in ("if", "while", "for", "switch"):
            for span in s.spans:
                if span:
                    self.nested(*span)
        return s, j

    def _statement(self, i: int, end: int) -> tuple[Statement | None, int]:
        k, ln, m = self.kinds[i], self.line(i), self.match_of
        if k == "{":
            return Statement("block", ln, bodies=[self.statements(i + 1, m[i])]), m[i] + 1
        if k in (";", "HTML"):
            return None, i + 1
        if k == "#[":
            return self.statement(m[i] + 1, end)
        if k in ("if", "elseif"):
            s = Statement("if", ln, [(i + 2, m[i + 1])])
            alt = self.kinds[m[i + 1] + 1] == ":"
            b, j = self.body(m[i + 1] + 1, end, ("elseif", "else", "endif"))
            s.bodies.append(b)
            while j < end and self.kinds[j] == "elseif":
                s.spans.append((j + 2, m[j + 1]))
                b, j = self.body(m[j + 1] + 1, end, ("elseif", "else", "endif"))
                s.bodies.append(b)
            if j < end and self.kinds[j] == "else":
                s.tail, j = self.body(j + 1, end, ("endif",))
            return s, j + 2 if alt and j < end and self.kinds[j] == "endif" else j
        if k in ("while", "for", "foreach"):
            close = m[i + 1]
            if k == "for":
                spans, a = [], i + 2
                while a <= close:
                    b = self.until(a, close, (";",))
                    spans.append((a, b))
                    a = b + 1
            else:
                spans = [(i + 2, close)]
            alt = self.kinds[close + 1] == ":"
            b, j = self.body(close + 1, end, ("end" + k,))
            return Statement("while" if k == "while" else "for", ln, spans, [b]), j + 2 if alt else j
        if k == "do":
            b, j = self.body(i + 1, end)
            return Statement("while", ln, [(j + 2, m[j + 1])], [b]), m[j + 1] + 2
        if k == "switch":
            close = m[i + 1]
            s, j = Statement("switch", ln, [(i + 2, close)]), close + 1
            stop = m[j] if self.kinds[j] == "{" else end
            j += 1
            while j < stop and self.kinds[j] != "endswitch":
                if self.kinds[j] in ("case", "default"):
                    c = self.until(j + 1, stop, (":", ";"))
                    while self.kinds[c] == ":" and self._ternary_open(j + 1, c):
                        c = self.until(c + 1, stop, (":", ";"))
                    label = (j + 1, c) if self.kinds[j] == "case" else None
                    j = c + 1
                    inner: list[Statement] = []
                    while j < stop and self.kinds[j] not in ("case", "default", "endswitch"):
                        st, j = self.statement(j, stop)
                        if st is not None:
                            inner.append(st)
                    s.spans.append(label)
                    s.bodies.append(inner)
                else:
                    j += 1
            return s, j + 1 if j >= len(self.toks) or self.kinds[j] == "}" else j + 2
        if k == "try":
            b, j = self.body(i + 1, end)
            s = Statement("try", ln, bodies=[b])
            while j < end and self.kinds[j] == "catch":
                for t in range(j + 2, m[j + 1]):
                    if self.kinds[t] in ("NAME", "QNAME"):
                        self.edge(self.toks[t][1], "catch", t)
                close = m[j + 1]
                b, j2 = self.body(close + 1, end)
                s.bodies.append(b)
                s.spans.append((j, close))
                j = j2
            if j < end and self.kinds[j] == "finally":
                s.tail, j = self.body(j + 1, end)
            return s, j
        if k == "namespace":
            j = i + 1
            if self.kinds[j] in ("NAME", "QNAME"):
                self.namespace, j = self.toks[j][1].strip("\\"), j + 1
            else:
                self.namespace = ""
            self.imports = {}
            if self.kinds[j] not in (";", "{"):
                raise Unreadable
            return (Statement("block", ln, bodies=[self.statements(j + 1, m[j])]), m[j] + 1) if self.kinds[j] == "{" else (None, j + 1)
        if k == "use" and not self.stack:
            return None, self.use(i)
        if k in ("class", "interface", "trait", "enum") or k in ("abstract", "final", "readonly"):
            j = i
            while self.kinds[j] in ("abstract", "final", "readonly"):
                j += 1
            if self.kinds[j] in ("class", "interface", "trait", "enum"):
                return None, self.class_like(j, tuple(self.kinds[i:j]))
        if k == "function" and (self.kinds[i + 1] == "NAME" or self.kinds[i + 1] == "&" and self.kinds[i + 2] == "NAME"):
            return None, self.function(i, "function", ())
        if k == "declare":
            j = m[i + 1] + 1
            return None, j + (self.kinds[j] in (";", ":"))
        if k == "NAME" and self.kinds[i + 1] == ":" and self.kinds[i + 2] != ":":
            return None, i + 2
        j = self.until(i, end, (";",))
        if j >= end:  # a statement that its block, or the file, cuts off
            raise Unreadable
        kind = k if k in ("return", "throw", "break", "continue", "goto", "echo", "exit", "global", "unset") else "expr"
        a = i + (kind != "expr")
        self.nested(i, j)
        return Statement(kind, ln, [(a, j)]), j + 1

    def _ternary_open(self, a: int, b: int) -> bool:
        return self.kinds[a:b].count("?") > self.kinds[a:b].count(":")

    def use(self, i: int) -> int:
        end = self.until(i, len(self.toks), (";",))
        if end >= len(self.toks):
            raise Unreadable
        parts = [t for t in self.toks[i + 1 : end] if t[0] not in ("function", "const")]
        prefix, last = "", None
        for n, (kind, text, _) in enumerate(parts):
            if kind in ("NAME", "QNAME"):
                if n and parts[n - 1][0] == "as":
                    self.imports.pop(last.rpartition("\\")[2].lower(), None)
                    self.imports[text.lower()] = last
                elif n + 1 < len(parts) and parts[n + 1][0] == "\\":
                    prefix = text.strip("\\") + "\\"
                else:
                    last = prefix + text.lstrip("\\")
                    self.imports[last.rpartition("\\")[2].lower()] = last
        return end + 1

    # -- declarations

    def type_at(self, i: int, stops: tuple[str, ...]) -> tuple[str, int]:
        out = []
        while self.kinds[i] not in stops and self.kinds[i] in ("NAME", "QNAME", "array", "callable", "static", "?", "|", "&", "(", ")") and not (self.kinds[i] == "&" and self.kinds[i + 1] in ("VAR", "...", "&")):
            if self.kinds[i] in ("NAME", "QNAME"):
                self.edge(self.toks[i][1], "type_hint", i)
            out.append(self.toks[i][1])
            i += 1
        return "".join(out), i

    def parameters(self, i: int) -> list:
        out, end, marked = [], self.match_of[i], False
        i += 1
        while i < end:
            if self.kinds[i] == "#[":
                names = [t[1].lstrip("\\").lower() for t in self.toks[i + 1 : self.match_of[i]] if t[0] in ("NAME", "QNAME")]
                marked, i = marked or "sensitiveparameter" in names, self.match_of[i] + 1
                continue
            promoted = False
            while self.kinds[i] in _MODIFIERS:
                promoted, i = True, i + 1
                if self.kinds[i] == "(" and self.kinds[i + 2] == ")":
                    i += 3
            kind, i = self.type_at(i, ("VAR",))
            while self.kinds[i] in ("&", "..."):
                i += 1
            name = self.toks[i][1]
            stop = self.until(i, end, (",",))
            self.nested(i, stop)
            out.append((name, kind, promoted, self.line(i), marked))
            marked, i = False, stop + 1
        return out

    def function(self, i: int, kind: str, modifiers: tuple) -> int:
        """A function or method from its keyword; returns where it ends."""
        j = i + 1 + (self.kinds[i + 1] == "&")
        name = self.toks[j][1]
        open_ = j + 1
        args = self.parameters(open_)
        j = self.match_of[open_] + 1
        returns = ""
        if self.kinds[j] == ":":
            returns, j = self.type_at(j + 1, ("{", ";"))
        owner = self.stack[-1].name if self.stack else self.namespace
        c = Callable_(name, owner, kind, self.line(i), self.line(i), args, returns, [], modifiers, (i, j))
        self.callables.append(c)
        if kind == "method":
            self.stack[-1].methods.append(c)
            for p in args:
                if p[2]:
                    self.stack[-1].properties.append((p[0], next((m for m in ("private", "protected") if m in self.kinds[open_ : self.match_of[open_]]), "public"), p[1], False, False))
        if self.kinds[j] != "{":
            return j + 1
        c.body, c.end_line, c.span = self.statements(j + 1, self.match_of[j]), self.line(self.match_of[j]), (j + 1, self.match_of[j])
        return self.match_of[j] + 1

    def class_like(self, i: int, modifiers: tuple, name: str | None = None) -> int:
        kind, j = self.kinds[i], i + 1
        if name is None:
            name, j = f"{self.namespace}\\{self.toks[j][1]}".strip("\\"), j + 1
        elif self.kinds[j] == "(":
            self.nested(j + 1, self.match_of[j])
            j = self.match_of[j] + 1
        c = Class_(name, "abstract" if "abstract" in modifiers else kind, self.line(i), modifiers=modifiers)
        self.stack.append(c)
        what = "type_hint"
        while self.kinds[j] != "{":
            if self.kinds[j] in ("extends", "implements"):
                what = self.kinds[j]
            elif self.kinds[j] in ("NAME", "QNAME"):
                (c.implements if what == "implements" else c.extends if what == "extends" else []).append(self.resolve(self.toks[j][1]))
                self.edge(self.toks[j][1], what, j)
            j += 1
        end, j = self.match_of[j], j + 1
        c.end_line = self.line(end)
        while j < end:
            k = self.kinds[j]
            if k == "#[":
                for t in range(j + 1, self.match_of[j]):
                    if self.kinds[t] in ("NAME", "QNAME") and self.kinds[t - 1] in ("#[", ","):
                        self.edge(self.toks[t][1], "attribute", t)
                j = self.match_of[j] + 1
            elif k == "use":
                stop = self.until(j, end, (";", "{"))
                for t in range(j + 1, stop):
                    if self.kinds[t] in ("NAME", "QNAME"):
                        c.uses.append(self.resolve(self.toks[t][1]))
                        self.edge(self.toks[t][1], "trait_use", t)
                j = (self.match_of[stop] if self.kinds[stop] == "{" else stop) + 1
            elif k == "case" or k == "const":
                stop = self.until(j, end, (";",))
                c.constants.append(self.toks[j + 1][1])
                self.nested(j, stop)
                j = stop + 1
            else:
                first = j
                while self.kinds[j] in _MODIFIERS:
                    j += 1
                    if self.kinds[j] == "(" and self.kinds[j - 1] in ("public", "protected", "private"):
                        j += 3
                mods = tuple(self.kinds[first:j])
                if self.kinds[j] == "function":
                    j = self.function(j, "method", mods)
                elif self.kinds[j] == "const":
                    continue
                else:
                    kind_, j = self.type_at(j, ("VAR",))
                    if self.kinds[j] != "VAR":
                        raise Unreadable
                    sight = next((m for m in ("private", "protected") if m in mods), "public")
                    stop = self.until(j, end, (";", "{"))
                    for t in range(j, stop):
                        if self.kinds[t] == "VAR" and self.kinds[t - 1] != "=" and (t == j or self.kinds[t - 1] == ","):
                            c.properties.append((self.toks[t][1], sight, kind_, "static" in mods, "readonly" in mods or "readonly" in modifiers))
                    self.nested(j, stop)
                    j = (self.match_of[stop] if self.kinds[stop] == "{" else stop) + 1
        self.stack.pop()
        self.classes.append(c)
        return end + 1

    def nested(self, a: int, b: int) -> None:
        """Closures, anonymous classes and references within an expression."""
        j = a
        while j < b:
            k = self.kinds[j]
            if k in ("function", "fn") and self.kinds[j + 1] in ("(", "&"):
                j = self.closure(j, b)
                continue
            if k == "new":
                t = j + 1
                if self.kinds[t] in ("NAME", "QNAME"):
                    self.edge(self.toks[t][1], "new", t)
                elif self.kinds[t] in ("class", "readonly"):
                    t += self.kinds[t] == "readonly"
                    j = self.class_like(t, (), f"{self.namespace}\\class@anonymous:{self.line(t)}".strip("\\"))
                    continue
            elif k in ("NAME", "QNAME") and self.kinds[j + 1] == "::":
                kind = "static_call" if self.kinds[j + 3] == "(" else "static_property" if self.kinds[j + 2] == "VAR" else "constant"
                self.edge(self.toks[j][1], kind, j)
            elif k == "instanceof" and self.kinds[j + 1] in ("NAME", "QNAME"):
                self.edge(self.toks[j + 1][1], "instanceof", j + 1)
            j += 1

    def closure(self, i: int, end: int) -> int:
        open_ = i + 1 + (self.kinds[i + 1] == "&")
        args = self.parameters(open_)
        j = self.match_of[open_] + 1
        if self.kinds[j] == "use":
            j = self.match_of[j + 1] + 1
        returns = ""
        if self.kinds[j] == ":":
            returns, j = self.type_at(j + 1, ("{", "=>"))
        owner = self.stack[-1].name if self.stack else self.namespace
        c = Callable_(f"{{closure:{self.line(i)}}}", owner, "anonymous", self.line(i), self.line(i), args, returns, [], (), (i, j))
        self.callables.append(c)
        if self.kinds[j] == "{":
            c.body, c.span, stop = self.statements(j + 1, self.match_of[j]), (i, self.match_of[j] + 1), self.match_of[j] + 1
        else:
            stop = min(end, self.until(j + 1, end, (",", ")", "]", ";")))
            self.nested(j + 1, stop)
            c.body, c.span = [Statement("return", self.line(j), [(j + 1, stop)])], (i, stop)
        return stop


class Measures:
    """Walks over one callable; spans of closures and anonymous classes inside it are skipped."""

    def __init__(self, parser: Parser, c: Callable_) -> None:
        self.p, self.c = parser, c
        inner = sorted(o.span for o in parser.callables if o is not c and c.span[0] <= o.span[0] and o.span[1] <= c.span[1])
        self.skip = {a: b for a, b in reversed(inner)}

    def tokens(self, span) -> Iterator[int]:
        i, end = span
        while i < end:
            if i in self.skip and self.skip[i] > i:
                i = self.skip[i]
                continue
            yield i
            i += 1

    def walk(self, body=None) -> Iterator[Statement]:
        for s in self.c.body if body is None else body:
            yield s
            for b in s.bodies:
                yield from self.walk(b)
            if s.tail:
                yield from self.walk(s.tail)

    def all_tokens(self) -> Iterator[int]:
        for s in self.walk():
            for span in s.spans:
                if span:
                    yield from self.tokens(span)

    def match_conditions(self, i: int) -> int:
        """Conditions of the arms of a match, from its keyword."""
        p, j = self.p, self.p.match_of[i + 1] + 1
        end, n, j = p.match_of[j], 0, j + 1
        while j < end:
            arrow = p.until(j, end, ("=>",))
            if p.kinds[j] != "default":
                k = j
                while k < arrow:
                    n += 1
                    k = p.until(k, arrow, (",",)) + 1
                    if k >= arrow:
                        break
            j = p.until(arrow + 1, end, (",",)) + 1
        return n

    def cyclomatic(self) -> int:
        n, kinds = 1, self.p.kinds
        for s in self.walk():
            if s.kind == "if":
                n += len(s.bodies)
            elif s.kind in ("while", "for"):
                n += 1
            elif s.kind == "switch":
                n += sum(x is not None for x in s.spans[1:])
            elif s.kind == "try":
                n += len(s.bodies) - 1
        for i in self.all_tokens():
            if kinds[i] in (*_AND, *_OR, "?", "??", "?->"):
                n += 1
            elif kinds[i] == "match":
                n += self.match_conditions(i)
        return n

    def cognitive(self) -> int:
        kinds, toks, name = self.p.kinds, self.p.toks, self.c.name.lower()

        def expression(span, nesting: int) -> int:
            n, family, levels = 0, None, []
            if not span:
                return 0
            for i in self.tokens(span):
                k = kinds[i]
                if k in ("(", "[", "{"):
                    levels.append(family)
                    family = None
                elif k in (")", "]", "}") and levels:
                    family = levels.pop()
                elif k in _AND or k in _OR:
                    mine = "and" if k in _AND else "or"
                    n += mine != family
                    family = mine
                elif k in ("?", "??"):
                    n += 1
                elif k == "match":
                    n += 1 + nesting
                elif k == "NAME" and toks[i][1].lower() == name and kinds[i + 1] == "(":
                    before, receiver = kinds[i - 1], toks[i - 2][1].lower() if i > 1 else ""
                    own = before in ("->", "?->") and receiver == "$this" or before == "::" and receiver in ("self", "static")
                    n += own if self.c.kind == "method" else before not in ("->", "?->", "::", "new") and self.c.kind == "function"
                elif k in (",", ";"):
                    family = None
            n += sum(1 + nesting for a in self.skip if span[0] <= a < span[1] and not any(x < a < self.skip[x] for x in self.skip))
            return n

        def block(body, nesting: int) -> int:
            n = 0
            for s in body:
                if s.kind == "if":
                    n += 1 + nesting + (len(s.bodies) - 1) + (s.tail is not None)
                elif s.kind in ("for", "while", "switch"):
                    n += 1 + nesting
                elif s.kind == "try":
                    n += (len(s.bodies) - 1) * (1 + nesting)
                elif s.kind == "goto" or s.kind in ("break", "continue") and kinds[s.spans[0][0]] == "INT":
                    n += 1
                for span in s.spans if s.kind != "try" else ():
                    n += expression(span, nesting)
                for at, b in enumerate(s.bodies):
                    deeper = s.kind in ("if", "for", "while", "switch") or s.kind == "try" and at > 0
                    n += block(b, nesting + deeper)
                if s.tail:
                    n += block(s.tail, nesting + (s.kind == "if"))
            return n

        return block(self.c.body, 0)

    def npath(self) -> float:
        kinds = self.p.kinds

        def expression(span) -> float:
            n = 0
            if span:
                for i in self.tokens(span):
                    k = kinds[i]
                    n += k in (*_AND, *_OR, "??", "??=", "?->") or 2 * (k == "?") or (self.match_conditions(i) + 1 if k == "match" else 0)
            return n

        def block(body) -> float:
            n = 1.0
            for s in body:
                if s.kind == "if":
                    m = sum(map(expression, s.spans)) + sum(map(block, s.bodies)) + (block(s.tail) if s.tail is not None else 1)
                elif s.kind in ("for", "while"):
                    m = sum(map(expression, s.spans)) + block(s.bodies[0]) + 1
                elif s.kind == "switch":
                    m = max(1, expression(s.spans[0]) + sum(expression(x) + max(1, block(b)) for x, b in zip(s.spans[1:], s.bodies)))
                elif s.kind == "try":
                    m = (sum(map(block, s.bodies)) + 1) * (block(s.tail) if s.tail else 1)
                elif s.kind == "block":
                    m = block(s.bodies[0])
                elif s.kind in ("expr", "return", "echo"):
                    m = max(1, sum(map(expression, s.spans)))
                else:
                    m = 1
                n = min(NPATH_MOST, n * m)
            return n

        return block(self.c.body)

    def statements(self) -> int:
        """Statements, and each branch, case and handler of one."""
        n = 0
        for s in self.walk():
            n += s.kind != "block"
            if s.kind in ("if", "try"):
                n += len(s.bodies) - 1 + (s.tail is not None)
            elif s.kind == "switch":
                n += len(s.bodies)
        return n

    def halstead(self) -> dict[str, float]:
        ops, args, kinds, toks = Counter(), Counter(), self.p.kinds, self.p.toks
        for s in self.walk():
            if s.kind in _CONTROL or s.kind == "exit":
                ops[s.kind] += 1
        for i in self.all_tokens():
            if kinds[i] in _OPERANDS:
                args[toks[i][1]] += 1
            elif kinds[i] in _OPERATORS or kinds[i] in _CONTROL or kinds[i] == "CAST":
                ops[toks[i][1].lower()] += 1
        n1, n2, m1, m2 = len(ops), len(args), sum(ops.values()), sum(args.values())
        volume = (m1 + m2) * math.log2(n1 + n2) if n1 + n2 > 1 else 0.0
        difficulty = n1 / 2 * m2 / n2 if n2 else 0.0
        return {"halstead.volume": volume, "halstead.difficulty": difficulty, "halstead.effort": volume * difficulty, "halstead.bugs": volume / 3000, "halstead.time": volume * difficulty / 18}

    def unreachable(self) -> tuple[int, int]:
        """Statements behind one that leaves, in the same list, and the first's line."""
        n, first = 0, 0

        def block(body) -> None:
            nonlocal n, first
            gone = False
            for s in body:
                if gone:
                    n, first = n + 1, first or s.line
                gone = gone or s.kind in ("return", "throw", "break", "continue", "exit")
                for b in (*s.bodies, s.tail or []):
                    block(b)

        block(self.c.body)
        return n, first

    def uses(self) -> tuple[set[str], set[str], set[str]]:
        """(own properties, own methods called, other calls)."""
        props, own, other, kinds, toks = set(), set(), set(), self.p.kinds, self.p.toks
        for i in range(*self.c.span):
            if kinds[i] == "NAME" and i > 1 and kinds[i - 1] in ("->", "?->", "::"):
                mine = toks[i - 2][1].lower() in ("$this", "self", "static")
                if kinds[i + 1] == "(":
                    (own if mine else other).add(toks[i][1].lower())
                elif mine and kinds[i - 1] != "::":
                    props.add("$" + toks[i][1])
            elif kinds[i] == "VAR" and i > 1 and kinds[i - 1] == "::" and toks[i - 2][1].lower() in ("self", "static"):
                props.add(toks[i][1])
            elif kinds[i] == "ENC_VAR" and toks[i][1].startswith("$this->"):
                props.add("$" + re.split(r"->", toks[i][1])[1])
            elif kinds[i] in ("NAME", "QNAME") and kinds[i + 1] == "(" and kinds[i - 1] not in ("function", "->", "?->", "::"):
                other.add(toks[i][1].lower())
        return props, own, other


def maintainability(volume: float, ccn: float, statements: float) -> float:
    """0 to 100, 100 where there is no volume."""
    if volume <= 0:
        return 100.0
    return max(0.0, min(100.0, (171 - 5.2 * math.log(volume) - 0.23 * ccn - 16.2 * math.log(max(1, statements))) * 100 / 171))


def _components(nodes: list[str], pairs: set[tuple[str, str]]) -> list[int]:
    root = {n: n for n in nodes}

    def find(x: str) -> str:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    return list(Counter(map(find, nodes)).values())


def class_values(p: Parser, c: Class_) -> dict[str, float]:
    methods = [m for m in c.methods if m.span[1] >= m.span[0]]
    use = {m.name.lower(): Measures(p, m).uses() for m in methods}
    props = {n for n, *_ in c.properties}
    sight = lambda m: next((v for v in ("private", "protected") if v in m.modifiers), "public")
    plain = [m for m in methods if m.name.lower() not in ("__construct", "__destruct") and "abstract" not in m.modifiers]
    alive = [m.name.lower() for m in plain if "static" not in m.modifiers]
    shared = {(a, b) for a in alive for b in alive if a < b and (use[a][0] & use[b][0] & props or a in use[b][1] or b in use[a][1])}
    lcom = 0 if not alive else len(_components(alive, shared))
    public = [m.name.lower() for m in plain if sight(m) == "public" and "static" not in m.modifiers]
    direct = {(a, b) for a in public for b in public if a < b and use[a][0] & use[b][0] & props}
    pairs = len(public) * (len(public) - 1) / 2
    tcc = len(direct) / pairs if pairs else 1.0
    lcc = sum(n * (n - 1) / 2 for n in _components(public, direct)) / pairs if pairs else 1.0
    accessor = lambda m: re.match(r"(get|is|has|set)[A-Z0-9_]", m.name) is not None and Measures(p, m).statements() <= 1
    getters = [m for m in methods if accessor(m) and not m.name.startswith("set")]
    setters = [m for m in methods if accessor(m) and m.name.startswith("set")]
    promoted = [x for m in methods for x in m.parameters if x[2]]
    ctor = [m for m in methods if m.name.lower() == "__construct"]
    pub = [m for m in methods if sight(m) == "public"]
    pub_props = [x for x in c.properties if x[1] == "public"]
    members = len(pub) - len([m for m in ctor if m in pub]) + len(pub_props)
    doing = len([m for m in pub if m not in getters and m not in setters and m not in ctor])
    own_calls, other = set().union(*(u[1] for u in use.values())), set().union(*(u[2] for u in use.values()))
    typed = {"param": [x[1] for m in methods for x in m.parameters], "return": [m.returns for m in methods if m.name.lower() not in ("__construct", "__destruct", "__clone")], "property": [x[2] for x in c.properties]}
    total, known = sum(map(len, typed.values())), sum(bool(t) for v in typed.values() for t in v)
    used_props = set().union(*(u[0] for u in use.values()))
    magic = {m.name.lower() for m in methods} & {"__get", "__set", "__call"}
    dead = [] if magic else [n for n, v, *_ in c.properties if v == "private" and n not in used_props] + [m.name for m in methods if sight(m) == "private" and m.name.lower() not in own_calls and not m.name.startswith("__")]
    out = {
        "lcom": lcom, "tcc": tcc, "lcc": lcc, "rfc": len(methods) + len(other), "rfc_own": len(methods), "rfc_external": len(other), "methodCountTotal": len(methods),
        "methodCount": len(methods) - len(getters) - len(setters) - len(ctor), "propertyCount": len(c.properties), "getterCount": len(getters), "setterCount": len(setters), "classLoc": c.end_line - c.line + 1,
        "woc": 100.0 if not members else math.floor(100 * doing / members + 0.5), "isDataClass": float(len(methods) - len(getters) - len(setters) - len(ctor) == 0), "isReadonly": float("readonly" in c.modifiers), "members": members,
        "isPromotedOnly": float(bool(c.properties) and len(promoted) == len(c.properties)), "isException": float(any(x.rpartition("\\")[2].endswith(("Exception", "Error")) for x in c.extends)),
        "isAbstract": float("abstract" in c.modifiers), "isInterface": float(c.kind == "interface"), "typeCoverage.pct": 100.0 if not total else round(100 * known / total, 2), "unusedPrivate": len(dead),
        "wmc": sum(Measures(p, m).cyclomatic() for m in methods), "constructorParameters": len(ctor[0].parameters) if ctor else 0,
    }
    for what in ("public", "protected", "private"):
        out[f"methodCount.{what}"], out[f"propertyCount.{what}"] = sum(sight(m) == what for m in methods), sum(x[1] == what for x in c.properties)
    for what, v in typed.items():
        out[f"typeCoverage.{what}.total"], out[f"typeCoverage.{what}.typed"] = len(v), sum(map(bool, v))
    return out


def file_values(text: str, p: Parser) -> dict[str, float]:
    lines = text.split("\n")
    touched, code = set(), {t[2] for t in p.toks if len(t[1]) > 1 and t[0] != "HTML"}
    for comment, line in p.comments:
        touched |= set(range(line, line + comment.count("\n") + 1))
    blank = sum(not x.strip() for x in lines)
    cloc = sum(i + 1 in touched and i + 1 not in code and bool(x.strip()) for i, x in enumerate(lines))
    kinds = Counter(c.kind for c in p.classes)
    return {"loc": len(lines), "blank": blank, "cloc": cloc, "lloc": len(lines) - blank - cloc, "functionCount": sum(c.kind == "function" for c in p.callables), **{f"{k}Count": kinds[k] for k in ("class", "abstract", "interface", "trait", "enum")}}


_DEBUG = frozenset(("var_dump", "print_r", "var_export", "dd", "dump", "debug_print_backtrace", "debug_zval_dump"))
_GLOBALS = frozenset(("$_GET", "$_POST", "$_REQUEST", "$_COOKIE", "$_SERVER", "$_FILES", "$_SESSION", "$_ENV", "$GLOBALS"))


def entries(p: Parser, tree: list[Statement]) -> Iterator[tuple[str, int, str]]:
    """(smell, line, detail) from tokens and statements."""
    yield from injections(p)
    for what, line in repeated(p, tree):
        yield "identical_subexpression", line, what
    kinds, toks = p.kinds, p.toks
    for i, (k, t, line) in enumerate(toks):
        if k == "NAME" and t.lower() in _DEBUG and kinds[i + 1] == "(" and kinds[i - 1] not in ("->", "?->", "::", "function"):
            yield "debug_code", line, t.lower()
        elif k == "eval":
            yield "eval", line, ""
        elif k == "exit":
            yield "exit", line, ""
        elif k == "goto":
            yield "goto", line, toks[i + 1][1]
        elif k == "@":
            yield "error_suppression", line, toks[i + 1][1]
        elif k == "VAR" and t in _GLOBALS:
            yield "superglobals", line, t
        elif k == "catch":
            body = p.match_of[i + 1] + 1
            if p.match_of.get(body) == body + 1:
                yield "empty_catch", line, ""
        elif k in ("for", "while") and kinds[i + 1] == "(":
            for j in range(i + 2, p.match_of[i + 1]):
                if kinds[j] == "NAME" and toks[j][1].lower() in ("count", "sizeof") and kinds[j + 1] == "(":
                    yield "count_in_loop", line, toks[j][1].lower()
        elif k in ("==", "===", "!=", "!==", "&&", "||", "-", "/", "%", "<", ">", "<=", ">=", "<=>", "and", "or", "xor"):
            a, b = operand(p, i, -1), operand(p, i, 1)
            if a and a == b:
                yield "identical_subexpression", line, f"identical_operands {k}"
    for c in p.callables:
        for name, kind, _, line, _ in c.parameters:
            if kind.lower().lstrip("?") == "bool":
                yield "boolean_argument", line, name.lstrip("$")


_ENDS = frozenset("; , ( ) [ ] { } = == === != !== && || - + * / % . < > <= >= <=> ? : ?? => and or xor return echo ! += -= .=".split())


def operand(p: Parser, i: int, step: int) -> tuple[str, ...]:
    """The simple operand beside an operator: a chain of names and accesses without brackets, bounded by operators."""
    out, j = [], i + step
    while 0 <= j < len(p.toks) and p.kinds[j] not in _ENDS:
        out.append(p.toks[j][1])
        j += step
    if 0 <= j < len(p.toks) and p.kinds[j] in ("(", "[", ")", "]", "*", "/", "%", ".", "+", "-") and not (step < 0 and p.kinds[j] == "(" or step > 0 and p.kinds[j] == ")"):
        return ()
    return tuple(out[::step])


_IGNORE = re.compile(r"@(?:\w+-)?ignore(?P<kind>-file|-next-line)?\s+(?P<selector>[\w.#*-]+)(?:\s+--\s*(?P<reason>.*))?")
_THRESHOLD = re.compile(r"@(?:\w+-)?threshold\s+(?P<selector>[\w.#*-]+)(?P<values>[ \t][^\n\r]*)?")
_NUMBER = r"-?\d+(?:\.\d+)?"
_VALUES = re.compile(rf"(?P<both>{_NUMBER})(?:\s+(?P<second>{_NUMBER}))?|(?=\S)(?:warning=(?P<w>{_NUMBER}))?\s*(?:error=(?P<e>{_NUMBER}))?")


def directives(p: Parser) -> Iterator[tuple[str, int, dict[str, str]]]:
    """(kind, line, details) of ignore and threshold comments; text in back-ticks is none. One number sets both thresholds;
    a threshold without a number, or with anything else, is malformed."""
    for comment, line in p.comments:
        for n, part in enumerate(comment.split("\n")):
            part = re.sub(r"`[^`]*`", "", part)
            if m := _IGNORE.search(part):
                kind = {"-file": "file", "-next-line": "next-line"}.get(m["kind"] or "", "symbol")
                yield kind, line + n, {"selector": m["selector"], "reason": (m["reason"] or "").replace("*/", "").strip()}
            elif m := _THRESHOLD.search(part):
                v = _VALUES.fullmatch((m["values"] or "").replace("*/", "").strip())
                detail = {"selector": m["selector"], "warning": "", "error": "", "malformed": str(v is None).lower()}
                if v:
                    detail["warning"], detail["error"] = v["both"] or v["w"] or "", v["second"] or v["both"] or v["e"] or ""
                yield "threshold", line + n, detail


def facts(text: str) -> list[tuple[str, str, str, int, dict[str, float], dict[str, str]]]:
    """All rows of one file."""
    try:
        p = Parser(text)
        tree = p.file()
    except (Unreadable, IndexError, KeyError, RecursionError):
        return [("failure", "", "", 0, {}, {})]
    out = [("file", "", "", 1, {k: float(v) for k, v in file_values(text, p).items()}, {})]
    ordinal: Counter = Counter()
    for c in p.classes:
        ordinal[c.name] += 1
        extra = {"kind": c.kind, "namespace": c.name.rpartition("\\")[0], "ordinal": str(ordinal[c.name]), "extends": ",".join(c.extends), "implements": ",".join(c.implements)}
        out.append(("class", c.name, "", c.line, {k: float(v) for k, v in class_values(p, c).items()}, extra))
    for c in p.callables:
        m = Measures(p, c)
        ccn, statements, h = m.cyclomatic(), m.statements(), m.halstead()
        dead, first = m.unreachable()
        value = {
            "ccn": ccn, "cognitive": m.cognitive(), "npath": m.npath(), "statements": statements, "parameters": len(c.parameters), "unreachable": dead, "unreachableLine": first,
            "mi": maintainability(h["halstead.volume"], ccn, statements), "isVoConstructor": c.name.lower() == "__construct" and not c.body and all(x[2] for x in c.parameters), **h,
        }
        out.append(("callable", f"{c.owner}::{c.name}", c.owner, c.line, {k: float(v) for k, v in value.items()}, {"kind": c.kind, "end_line": str(c.end_line)}))
        for name, _, _, line, marked in c.parameters:
            out.append(("parameter", name.lstrip("$"), f"{c.owner}::{c.name}", line, {}, {"sensitive": str(marked).lower()}))
    out += [("edge", s, t, line, {}, {"dep_type": kind}) for s, t, kind, line in p.edges]
    out += [("entry", kind, "", line, {}, {"detail": detail}) for kind, line, detail in entries(p, tree)]
    out += [("directive", kind, "", line, {}, detail) for kind, line, detail in directives(p)]
    return out

"""Request input that reaches SQL, output or a shell, and conditions that repeat: found on the tokens of a parsed file."""

from __future__ import annotations

import re
from collections.abc import Iterator

# fixed values: where input comes from, where it must not go, and what makes it harmless
INPUT = ("$_GET", "$_POST", "$_REQUEST", "$_COOKIE")
SQL_FUNCTIONS = ("mysql_query", "mysqli_query", "pg_query", "pg_query_params", "sqlite_query")
COMMAND_FUNCTIONS = ("exec", "system", "passthru", "shell_exec", "proc_open", "popen")
HARMLESS_OUTPUT = ("htmlspecialchars", "htmlentities", "strip_tags", "intval")
HARMLESS_COMMAND = ("escapeshellarg", "escapeshellcmd")
HARMLESS_SQL = ("intval",)

_SQL_WORD = re.compile(r"\b(?:select|insert|update|delete)\b", re.I)
_NUMBER_CAST = re.compile(r"\(\s*(?:int|integer|float|double|bool|boolean)\s*\)", re.I)
_OPEN, _CLOSE = ("(", "[", "{", "#[", "ENC_OPEN", "DQ_OPEN"), (")", "]", "}", "ENC_CLOSE", "DQ_CLOSE")
_BOUND = frozenset("; , = => == === != !== < > <= >= <=> && || and or xor ? : ?? += .= return echo print HTML".split())


def _is_call(p, i: int) -> bool:
    return p.kinds[i] in ("NAME", "QNAME", "eval", "exit", "print") and p.kinds[i + 1] == "(" and (i == 0 or p.kinds[i - 1] not in ("->", "?->", "::", "function", "new"))


def name_of(p, i: int) -> str:
    return p.toks[i][1].lstrip("\\").lower()


def inputs(p, a: int, b: int, harmless: tuple[str, ...]) -> list[str]:
    """The input variables between two tokens that no harmless function, and no cast to a number, wraps."""
    out, i = [], a
    while i < b:
        kind, text = p.kinds[i], p.toks[i][1]
        if _is_call(p, i) and name_of(p, i) in harmless:
            i = p.match_of[i + 1] + 1
            continue
        if kind == "CAST" and _NUMBER_CAST.fullmatch(text) and i + 1 < b:
            i += 2
            while i < b and p.kinds[i] == "[":
                i = p.match_of[i] + 1
            continue
        if kind == "VAR" and text in INPUT or kind == "ENC_VAR" and text.split("[")[0].split("-")[0] in INPUT:
            out.append(text.split("[")[0])
        i += 1
    return out


def parts(p, a: int, b: int) -> Iterator[tuple[int, int]]:
    """The pieces between commas that no bracket encloses."""
    while a < b:
        stop = p.until(a, b, (",",))
        yield a, stop
        a = stop + 1


def _chain(p, i: int, opener: dict[int, int]) -> tuple[int, int]:
    """The expression around a token up to what binds looser than a concatenation, or the bracket around it."""
    a = i
    while a > 0 and p.kinds[a - 1] not in _BOUND and p.kinds[a - 1] not in _OPEN:
        a = opener.get(a - 1, a - 1)
    b = i
    while b < len(p.toks) and p.kinds[b] not in _BOUND and p.kinds[b] not in _CLOSE:
        b = p.match_of.get(b, b) + 1
    return a, b


def injections(p) -> Iterator[tuple[str, int, str]]:
    """(sql_injection, xss or command_injection; line; input variable), one a statement, call or concatenation."""
    kinds, toks = p.kinds, p.toks
    opener = {close: open_ for open_, close in p.match_of.items()}
    seen: set[int] = set()  # concatenations already looked at, by where they begin
    for i, (kind, _, line) in enumerate(toks):
        if kind in ("echo", "OPEN_ECHO", "print"):
            for a, b in parts(p, i + 1, p.until(i + 1, len(toks), (";",)) if kind != "print" else _chain(p, i + 1, opener)[1]):
                if found := inputs(p, a, b, HARMLESS_OUTPUT):
                    yield "xss", line, found[0]
        elif _is_call(p, i):
            name, a, b = name_of(p, i), i + 2, p.match_of[i + 1]
            if name in COMMAND_FUNCTIONS and (found := inputs(p, a, b, HARMLESS_COMMAND)):
                yield "command_injection", line, found[0]
            elif name in SQL_FUNCTIONS and (found := inputs(p, a, b, HARMLESS_SQL)):
                seen.update(range(a, b))
                yield "sql_injection", line, found[0]
            elif name == "sprintf":
                first, *rest = parts(p, a, b)
                if any(_SQL_WORD.search(toks[j][1]) for j in range(*first) if kinds[j] in ("STR", "DQ_CLOSE")) and rest and (found := inputs(p, rest[0][0], b, HARMLESS_SQL)):
                    yield "sql_injection", line, found[0]
        elif kind in ("STR", "DQ_CLOSE") and _SQL_WORD.search(toks[i][1]) and i not in seen:
            a, b = _chain(p, i if kind == "STR" else opener[i], opener)
            if a not in seen and ("." in kinds[a:b] or kind == "DQ_CLOSE") and (found := inputs(p, a, b, HARMLESS_SQL)):
                yield "sql_injection", toks[a][2], found[0]
            seen.update(range(a, b))


def _span_text(p, span) -> tuple[str, ...]:
    return tuple(t if k in ("STR", "VAR", "DQ_CLOSE", "ENC_VAR") else t.lower() for k, t, _ in p.toks[span[0] : span[1]])


def repeated(p, tree) -> Iterator[tuple[str, int]]:
    """(duplicate_condition, duplicate_switch_case, duplicate_match_arm or identical_ternary_branches; line)."""

    def walk(body) -> Iterator[tuple[str, int]]:
        for s in body:
            spans = s.spans if s.kind == "if" else [x for x in s.spans[1:] if x is not None] if s.kind == "switch" else []
            yield from again("duplicate_condition" if s.kind == "if" else "duplicate_switch_case", spans)
            for b in (*s.bodies, s.tail or []):
                yield from walk(b)

    def again(what: str, spans) -> Iterator[tuple[str, int]]:
        before = set()
        for span in spans:
            text = _span_text(p, span)
            if text in before:
                yield what, p.line(span[0])
            before.add(text)

    for body in (tree, *(c.body for c in p.callables)):
        yield from walk(body)
    for i, kind in enumerate(p.kinds[:-1]):
        if kind == "match" and p.kinds[i + 1] == "(":
            j = p.match_of[i + 1] + 1
            end, j, spans = p.match_of[j], j + 1, []
            while j < end:
                arrow = p.until(j, end, ("=>",))
                if p.kinds[j] != "default":
                    spans += [x for x in parts(p, j, arrow) if x[0] < x[1]]
                j = p.until(arrow + 1, end, (",",)) + 1
            yield from again("duplicate_match_arm", spans)
        elif kind == "?" and p.kinds[i + 1] != ":":
            colon = p.until(i + 1, len(p.toks), (":", ";", ",", "?", "=>"))
            if p.kinds[colon] == ":":
                end = p.until(colon + 1, len(p.toks), (";", ",", ")", "]", "}", ":", "?", "=>"))
                if _span_text(p, (i + 1, colon)) == _span_text(p, (colon + 1, end)) != ():
                    yield "identical_ternary_branches", p.line(i)

"""Tokens of PHP 8.4 source text.

A token is (kind, text, line). Kinds: keywords and operators stand for themselves (keywords in lower case); NAME, QNAME
(with a backslash), VAR, INT, FLOAT, STR (without interpolation), CAST, HTML, OPEN_ECHO, and for interpolated text
DQ_OPEN ... DQ_CLOSE, in which ENC_VAR is a simple variable and ENC_OPEN expression ENC_CLOSE a braced one. BAD marks what
no lexer accepts; nothing follows it. Comments go to a list of their own.
"""

from __future__ import annotations

import re

# fixed values: the reserved words of PHP 8.4
KEYWORDS = frozenset(
    """__halt_compiler abstract and array as break callable case catch class clone const continue declare default do
    echo else elseif empty enddeclare endfor endforeach endif endswitch endwhile eval exit extends final finally fn for
    foreach function global goto if implements include include_once instanceof insteadof interface isset list match
    namespace new or print private protected public readonly require require_once return static switch throw trait try
    unset use var while xor yield __class__ __dir__ __file__ __function__ __line__ __method__ __namespace__ __trait__
    __property__""".split()
)
MAGIC = frozenset("__class__ __dir__ __file__ __function__ __line__ __method__ __namespace__ __trait__ __property__".split())

_ID = r"[a-zA-Z_\x80-\U0010ffff][a-zA-Z0-9_\x80-\U0010ffff]*"
_CODE = re.compile(
    rf"""(?P<space>[ \t\r\n]+)
|(?P<line>(?://|\#(?!\[))(?:(?!\?>)[^\r\n])*)
|(?P<block>/\*(?s:.*?)\*/)
|(?P<open_block>/\*)
|(?P<close>\?>(?:\r\n|\n|\r)?)
|(?P<heredoc><<<[ \t]*(?:"(?P<hd>{_ID})"|'(?P<hn>{_ID})'|(?P<hi>{_ID}))(?:\r\n|\n|\r))
|(?P<var>\${_ID})
|(?P<qname>namespace(?:\\{_ID})+|\\{_ID}(?:\\{_ID})*|{_ID}(?:\\{_ID})+)
|(?P<name>{_ID})
|(?P<number>0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*|0[bB][01]+(?:_[01]+)*|0[oO][0-7]+(?:_[0-7]+)*
   |(?:[0-9]+(?:_[0-9]+)*)?\.[0-9]+(?:_[0-9]+)*(?:[eE][+-]?[0-9]+(?:_[0-9]+)*)?|[0-9]+(?:_[0-9]+)*\.?(?:[eE][+-]?[0-9]+(?:_[0-9]+)*)?)
|(?P<single>[bB]?'(?:[^'\\]|\\(?s:.))*')
|(?P<double>[bB]?"(?:[^"\\$\{{]|\\(?s:.)|\$(?![a-zA-Z_\x80-\U0010ffff\{{])|\{{(?!\$))*")
|(?P<cast>\([ \t]*(?:int|integer|bool|boolean|float|double|real|string|array|object|unset|binary)[ \t]*\))
|(?P<op>\#\[|\?->|<<=|>>=|\*\*=|\.\.\.|<=>|===|!==|\?\?=|\+\+|--|->|=>|::|==|!=|<>|<=|>=|&&|\|\||\?\?|\+=|-=|\*=|/=|\.=|%=|&=|\|=|\^=|<<|>>|\*\*|[-+*/%=<>!.,;:?()\[\]{{}}&|^~@$\\"`])
""",
    re.X | re.I,
)
_OPEN = re.compile(r"<\?(?:=|php(?=[ \t\r\n]|$))", re.I)
_SIMPLE = re.compile(rf"\${_ID}(?:\[(?:-?[0-9]+|-?0[xX][0-9a-fA-F]+|{_ID}|\${_ID})\]|\??->{_ID})?")
_INDEXED = re.compile(rf"\${_ID}\[")
_ENUM = re.compile(rf"enum[ \t\r\n]+(?!(?:extends|implements)\b){_ID}", re.I)
_YIELD = re.compile(r"[ \t\r\n]+from\b", re.I)
_STOP = {'"': re.compile(r'["\\$\{]'), "`": re.compile(r"[`\\$\{]"), "": re.compile(r"[\\$\{]")}


class _Bad(Exception):
    pass


class Lexer:
    def __init__(self, text: str) -> None:
        self.text, self.tokens, self.comments = text, [], []
        self.line, self.marked, self.opened = 1, 0, False

    def at(self, pos: int) -> int:
        """The line of an offset; offsets only grow."""
        self.line += self.text.count("\n", self.marked, pos)
        self.marked = max(self.marked, pos)
        return self.line

    def run(self) -> list[tuple[str, str, int]]:
        pos, n, text = 0, len(self.text), self.text
        try:
            while pos < n:
                m = _OPEN.search(text, pos)
                if m is None or m.start() > pos:
                    end = m.start() if m else n
                    self.tokens.append(("HTML", text[pos:end], self.at(pos)))
                    if m is None:
                        break
                self.opened = True
                if m.group() == "<?=":
                    self.tokens.append(("OPEN_ECHO", "<?=", self.at(m.start())))
                pos = self.code(m.end(), n, "")
        except _Bad:
            self.tokens.append(("BAD", "", self.line))
        return self.tokens

    def code(self, pos: int, end: int, closer: str) -> int:
        """Tokens of code from `pos`: up to a closing tag (or the end), or with `closer` '}' up to the brace that closes."""
        text, put, depth = self.text, self.tokens.append, 0
        match = _CODE.match
        while pos < end:
            m = match(text, pos, end)
            if m is None:
                raise _Bad
            kind, s = m.lastgroup, m.group()
            if kind in ("hd", "hn", "hi"):
                kind = "heredoc"
            start, pos = pos, m.end()
            if kind == "space":
                continue
            line = self.at(start)
            if kind == "op":
                if s in ('"', "`"):
                    pos = self.quoted(pos, end, s)
                    continue
                if closer:
                    depth += (s == "{") - (s == "}")
                    if depth < 0:
                        put(("ENC_CLOSE", s, line))
                        return pos
                put((s, s, line))
            elif kind == "var":
                put(("VAR", s, line))
            elif kind == "name":
                low = s.lower()
                last = self.tokens[-1][0] if self.tokens else ""
                if last in ("->", "?->", "::") and not (last == "::" and low == "class"):
                    put(("NAME", s, line))
                elif low in KEYWORDS or low == "die":
                    if low == "yield" and (f := _YIELD.match(text, pos)):
                        pos, low = f.end(), "yield from"
                    put(("exit" if low == "die" else "MAGIC" if low in MAGIC else low, s, line))
                    if low == "__halt_compiler":
                        return self.halt(pos)
                elif low == "enum" and _ENUM.match(text, start):
                    put(("enum", s, line))
                else:
                    put(("NAME", s, line))
            elif kind == "qname":
                put(("QNAME", s, line))
            elif kind == "number":
                low = s.lower()
                number = "INT" if low.startswith(("0x", "0b", "0o")) or not re.search(r"[.e]", low) else "FLOAT"
                if number == "INT" and re.fullmatch(r"0[0-9_]*[89][0-9_]*", s):
                    raise _Bad
                put((number, s, line))
            elif kind in ("single", "double"):
                put(("STR", s, line))
            elif kind == "cast":
                put(("CAST", s, line))
            elif kind in ("line", "block"):
                self.comments.append((s, line))
            elif kind == "heredoc":
                pos = self.heredoc(m, end)
            elif kind == "close":
                if closer:
                    raise _Bad
                put((";", s, line))
                return pos
            else:
                raise _Bad
        if closer:
            raise _Bad
        return pos

    def halt(self, pos: int) -> int:
        """What follows the end of the compiled part is data."""
        m = re.compile(r"\s*\(\s*\)\s*(?:;|\?>)").match(self.text, pos)
        if m is None:
            raise _Bad
        self.tokens.append((";", ";", self.at(pos)))
        return len(self.text)

    def quoted(self, pos: int, end: int, quote: str) -> int:
        """Interpolated text from `pos` up to `quote` (or to `end` for heredocs, whose quote is '')."""
        text, stop, begin = self.text, _STOP[quote], pos
        self.tokens.append(("DQ_OPEN", quote, self.at(pos)))
        while True:
            m = stop.search(text, pos, end)
            if m is None:
                if quote:
                    raise _Bad
                pos = end
                break
            pos, s = m.start(), m.group()
            if s == quote:
                pos += 1
                break
            if s == "\\":
                pos += 2
            elif text.startswith("{$", pos):
                self.tokens.append(("ENC_OPEN", "{", self.at(pos)))
                pos = self.code(pos + 1, end, "}")
            elif text.startswith("${", pos):
                self.tokens.append(("ENC_OPEN", "${", self.at(pos)))
                pos = self.code(pos + 2, end, "}")
            elif s == "$" and (v := _SIMPLE.match(text, pos, end)):
                if v.group().endswith("]") is False and _INDEXED.match(text, pos, end):
                    raise _Bad
                self.tokens.append(("ENC_VAR", v.group(), self.at(pos)))
                pos = v.end()
            else:
                pos += 1
        self.tokens.append(("DQ_CLOSE", text[begin : min(pos, end)], self.at(min(pos, end))))  # with the whole text
        return pos

    def heredoc(self, m: re.Match, end: int) -> int:
        label, nowdoc = m.group("hd") or m.group("hn") or m.group("hi"), m.group("hn") is not None
        body = m.end()
        close = re.compile(rf"^([ \t]*){label}(?![a-zA-Z0-9_\x80-\U0010ffff])", re.M).search(self.text, body, end)
        if close is None:
            raise _Bad
        indent, lines = close.group(1), self.text[body : close.start()]
        if indent and any(x.strip("\r") and not x.startswith(indent) for x in lines.split("\n") if x.strip(" \t\r")):
            raise _Bad
        if nowdoc:
            self.tokens.append(("STR", lines, self.at(m.start())))
        else:
            self.quoted(body, max(body, close.start()), "")
        return close.end()


def tokens(text: str) -> list[tuple[str, str, int]]:
    return Lexer(text).run()

"""Texts to token kinds, for the grammars. A lexer returns None for a text of which it can't make tokens."""

from __future__ import annotations

import io
import keyword
import re
import tokenize
import unicodedata

from codestrata.frontend import php_lexer

# ---- JSON ----

_JSON = re.compile(
    r"""[ \t\r\n]+|(?P<STRING>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")"""
    r"""|(?P<NUMBER>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)(?![0-9A-Za-z.+-])|(?P<WORD>true|false|null)(?![0-9A-Za-z_])|(?P<op>[{}\[\],:])"""
)


def json_kinds(text: str) -> list[str] | None:
    out, pos = [], 0
    while pos < len(text):
        m = _JSON.match(text, pos)
        if m is None:
            return None
        pos = m.end()
        if m.lastgroup:
            out.append(m.group() if m.lastgroup == "op" else m.lastgroup)
    return out


# ---- XML ----

_NAME = r"[:A-Za-z_\xc0-\xd6\xd8-\xf6\xf8-˿Ͱ-ͽͿ-῿‌‍⁰-↏Ⰰ-⿯、-퟿豈-﷏ﷰ-�\U00010000-\U000effff][-.0-9:A-Za-z_\xb7\xc0-\xd6\xd8-\xf6\xf8-ͽͿ-῿‌‍‿⁀⁰-↏Ⰰ-⿯、-퟿豈-﷏ﷰ-�\U00010000-\U000effff]*"
_SP = r"[ \t\r\n]*"
_S, _LITERAL = r"[ \t\r\n]+", r"(?:\"[^\"]*\"|'[^']*')"
_EXTERNAL = rf"(?:SYSTEM{_S}{_LITERAL}|PUBLIC{_S}{_LITERAL}{_S}{_LITERAL})"
_XML = re.compile(
    rf"""(?P<COMMENT><!--(?:(?!--)(?s:.))*-->)|(?P<CDATA><!\[CDATA\[(?s:.*?)\]\]>)
|(?P<DOCTYPE><!DOCTYPE{_S}{_NAME}(?:{_S}{_EXTERNAL})?[ \t\r\n]*(?:\[(?:[ \t\r\n]|%{_NAME};|<!--(?:(?!--)(?s:.))*-->|<\?{_NAME}(?:{_S}(?s:.*?))?\?>
   |<!ENTITY{_S}(?:%{_S})?{_NAME}{_S}(?:{_LITERAL}|{_EXTERNAL}(?:{_S}NDATA{_S}{_NAME})?)[ \t\r\n]*>
   |<!NOTATION{_S}{_NAME}{_S}(?:{_EXTERNAL}|PUBLIC{_S}{_LITERAL})[ \t\r\n]*>
   |<!(?:ELEMENT|ATTLIST){_S}{_NAME}(?:[^<>"']|{_LITERAL})*>)*\][ \t\r\n]*)?>)
|(?P<PI><\?(?P<target>{_NAME})(?:[ \t\r\n](?s:.*?))?\?>)
|(?P<CLOSE></(?P<end>{_NAME})[ \t\r\n]*>)
|<(?P<tag>{_NAME})(?P<attributes>(?:[ \t\r\n]+{_NAME}[ \t\r\n]*=[ \t\r\n]*(?:"[^<"]*"|'[^<']*'))*)[ \t\r\n]*(?P<slash>/?)>
|(?P<SPACE>[ \t\r\n]+(?=<|$))|(?P<TEXT>[^<]+)""",
    re.X,
)
_ATTRIBUTE = re.compile(rf"[ \t\r\n]+({_NAME})[ \t\r\n]*=[ \t\r\n]*(\"[^<\"]*\"|'[^<']*')")
_REFERENCE = re.compile(rf"&(?:(?P<name>{_NAME})|\#(?P<dec>[0-9]+)|\#x(?P<hex>[0-9a-fA-F]+));|(?P<bare>&)", re.X)
_XML_DECL = re.compile(r"""<\?xml[ \t\r\n]+version[ \t\r\n]*=[ \t\r\n]*(?:"1\.[0-9]+"|'1\.[0-9]+')(?:[ \t\r\n]+encoding[ \t\r\n]*=[ \t\r\n]*(?:"[A-Za-z][-A-Za-z0-9._]*"|'[A-Za-z][-A-Za-z0-9._]*'))?(?:[ \t\r\n]+standalone[ \t\r\n]*=[ \t\r\n]*(?:"(?:yes|no)"|'(?:yes|no)'))?[ \t\r\n]*\?>""")
_XML_BAD = re.compile("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")


_DECLARED = re.compile(
    rf"""<!--(?:(?!--)(?s:.))*-->|<\?(?s:.*?)\?>|(?P<parameter>%{_NAME};)
|<!ENTITY{_S}(?P<pe>%{_S})?(?P<entity>{_NAME}){_S}(?:(?P<value>{_LITERAL})|{_EXTERNAL}(?P<ndata>{_S}NDATA{_S}{_NAME})?)
|<!ELEMENT{_S}{_NAME}(?P<element>(?:[^<>"'])*)>|<!ATTLIST{_S}{_NAME}(?P<attlist>(?:[^<>"']|{_LITERAL})*)>""",
    re.X,
)
_MIXED = re.compile(rf"\({_SP}\#PCDATA(?:{_SP}\|{_SP}{_NAME})*{_SP}\)\*|\({_SP}\#PCDATA{_SP}\)".replace("\\#", "#"))
_GROUP = re.compile(rf"\({_SP}(?:{_NAME}[?*+]?)(?:(?:{_SP},{_SP}{_NAME}[?*+]?)*|(?:{_SP}\|{_SP}{_NAME}[?*+]?)*){_SP}\)[?*+]?")
_ENUMERATED = rf"\({_SP}[-.:\w]+(?:{_SP}\|{_SP}[-.:\w]+)*{_SP}\)"
_ATTRIBUTE_DEFINITION = re.compile(
    rf"{_S}{_NAME}{_S}(?:CDATA|IDREFS?|ID|ENTITY|ENTITIES|NMTOKENS?|NOTATION{_S}{_ENUMERATED}|{_ENUMERATED}){_S}"
    rf"(?:#REQUIRED|#IMPLIED|(?:#FIXED{_S})?(?:\"[^<\"]*\"|'[^<']*'))"
)


def _content_model(text: str) -> bool:
    """Whether an element's declaration is EMPTY, ANY, mixed content or groups of names; innermost groups become names."""
    if not text[:1].isspace():
        return False
    text = text.strip(" \t\r\n")
    if text in ("EMPTY", "ANY") or _MIXED.fullmatch(text):
        return True
    while text.startswith("(") and (m := _GROUP.search(text)):
        if m.start() == 0:
            return m.end() == len(text)
        text = text[: m.start()] + "g" + text[m.end() :]  # what follows a group may follow a name
    return False


class _Entities:
    """What the declarations of a document say about entities, and whether references to them are allowed."""

    def __init__(self) -> None:
        self.values: dict[str, str | None] = {n: "" for n in ("amp", "lt", "gt", "apos", "quot")}
        self.open = False  # others may be declared where only a reader of external subsets sees it
        self.unparsed: set[str] = set()
        self.sound: dict[tuple[str, bool], bool] = {}

    def declare(self, doctype: str, standalone: bool) -> bool:
        """Take in a document type declaration; False if a declaration in it can't be."""
        head, _, rest = doctype.partition("[")
        self.open = bool(re.search(r"[ \t\r\n](?:SYSTEM|PUBLIC)[ \t\r\n]", head)) and not standalone
        for m in _DECLARED.finditer(rest):
            if m["parameter"]:
                self.open = not standalone
            elif m["element"] is not None:
                if not _content_model(m["element"]):
                    return False
            elif m["attlist"] is not None:
                if not re.fullmatch(rf"(?:{_ATTRIBUTE_DEFINITION.pattern})*[ \t\r\n]*", m["attlist"]):
                    return False
            elif m["entity"] and not m["pe"]:
                value = m["value"][1:-1] if m["value"] else None
                if value is not None and ("%" in value or not _references_well_formed(value)):
                    return False
                self.values.setdefault(m["entity"], value)
                if m["ndata"]:
                    self.unparsed.add(m["entity"])
        return True

    def allowed(self, text: str, attribute: bool, within: tuple[str, ...] = ()) -> bool | None:
        """Whether all references in a text may be there; None if one isn't declared but may be outside."""
        out: bool | None = True
        for m in _REFERENCE.finditer(text):
            if m["bare"] or not m["name"] and not _is_character(m):
                return False
            name = m["name"]
            if not name:
                continue
            if name not in self.values:
                if not self.open:
                    return False
                out = None
            elif name in within or name in self.unparsed or attribute and self.values[name] is None:
                return False
            elif self.values[name] and len(within) < 100:
                key = (name, attribute)
                if key not in self.sound:
                    self.sound[key] = self._sound(self.values[name], attribute, (*within, name))
                if not self.sound[key]:
                    return False
        return out

    def _sound(self, value: str, attribute: bool, within: tuple[str, ...]) -> bool:
        """Whether an entity's text can stand in an attribute, or is content whose tags are balanced."""
        value = re.sub(r"&#(?:x([0-9a-fA-F]+)|([0-9]+));", lambda m: chr(int(m[1], 16) if m[1] else int(m[2])), value)
        if attribute:
            return "<" not in value and self.allowed(value, True, within) is not False
        out: list[str] = []
        return _markup(value, 0, self, out, within) and "DOCTYPE" not in out


def _is_character(m: re.Match) -> bool:
    code = int(m["dec"]) if m["dec"] else int(m["hex"], 16)
    return code <= 0x10FFFF and not _XML_BAD.match(chr(code))


def _references_well_formed(text: str) -> bool:
    return all(not m["bare"] and (m["name"] or _is_character(m)) for m in _REFERENCE.finditer(text))


def _markup(text: str, pos: int, entities: _Entities, out: list[str], within: tuple[str, ...] = ()) -> bool:
    """Append the kinds of a text from `pos`; False if tags don't match, an attribute is repeated, or a reference is bad."""
    stack: list[str] = []
    standalone = "DECL" in out and re.search("standalone[ \t\r\n]*=[ \t\r\n]*.yes", text[:pos]) is not None
    while pos < len(text):
        m = _XML.match(text, pos)
        if m is None:
            return False
        pos = m.end()
        if m["tag"]:
            names = _ATTRIBUTE.findall(m["attributes"]) if m["attributes"] else ()
            if len({a for a, _ in names}) < len(names):
                return False
            if "&" in m["attributes"] and (ok := entities.allowed(m["attributes"], True, within)) is not True:
                if ok is False:
                    return False
                out.append("UNDECLARED")
            out.append("EMPTY" if m["slash"] else "OPEN")
            if not m["slash"]:
                stack.append(m["tag"])
            continue
        kind = next(k for k in ("COMMENT", "CDATA", "DOCTYPE", "PI", "CLOSE", "SPACE", "TEXT") if m[k])
        if kind == "CLOSE" and (not stack or stack.pop() != m["end"]) or kind == "PI" and m["target"].lower() == "xml":
            return False
        if kind == "DOCTYPE" and not entities.declare(m.group(), standalone):
            return False
        if kind == "TEXT":
            if "]]>" in m.group():
                return False
            if "&" in m.group() and (ok := entities.allowed(m.group(), False, within)) is not True:
                if ok is False:
                    return False
                out.append("UNDECLARED")
        out.append(kind)
    return not stack


def xml_kinds(text: str) -> list[str] | None:
    """Kinds of an XML text; what no grammar can say (names of tags match, attributes are unique, entities are declared,
    balanced and not part of themselves) is checked on the way. UNDECLARED stands before a tag or text with a reference
    that only an external part of the document type could declare."""
    if _XML_BAD.search(text):
        return None
    out: list[str] = []
    pos = int(text.startswith("\ufeff"))
    if m := _XML_DECL.match(text, pos):
        out.append("DECL")
        pos = m.end()
    return out if _markup(text, pos, _Entities(), out) else None


# ---- Python ----

_SKIP = frozenset((tokenize.COMMENT, tokenize.NL, tokenize.ENCODING, tokenize.ENDMARKER, tokenize.TYPE_COMMENT, tokenize.TYPE_IGNORE))
_PLAIN = {
    tokenize.NUMBER: "NUMBER", tokenize.NEWLINE: "NEWLINE", tokenize.INDENT: "INDENT", tokenize.DEDENT: "DEDENT",
    tokenize.FSTRING_START: "FS_START", tokenize.FSTRING_MIDDLE: "FS_MIDDLE", tokenize.FSTRING_END: "FS_END",
}
_KEYWORDS = frozenset(keyword.kwlist)
_D = r"[0-9](?:_?[0-9])*"
_NUMBER = re.compile(
    rf"0(?:_?0)*|[1-9](?:_?[0-9])*|0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+"
    rf"|(?:{_D}\.(?:{_D})?|\.{_D})(?:[eE][+-]?{_D})?[jJ]?|{_D}[eE][+-]?{_D}[jJ]?|{_D}[jJ]"
)
_ESCAPES = re.compile(r"\\(?:x(?P<x>[0-9a-fA-F]{0,2})|u(?P<u>[0-9a-fA-F]{0,4})|U(?P<U>[0-9a-fA-F]{0,8})|N(?P<N>(?:\{[^}]*\})?)|(?s:.))")
_AFTER_SOFT = frozenset("= . , ) ] } : ; ! == != < > <= >= + / % @ & | ^ and or if else in is NEWLINE += -= := **".split())


def _escapes_fit(body: str, is_bytes: bool) -> bool:
    """Whether the escapes of a string that isn't raw are complete and name characters."""
    for m in _ESCAPES.finditer(body) if "\\" in body else ():
        if m["x"] is not None:
            if len(m["x"]) < 2:
                return False
        elif is_bytes:
            continue
        elif m["u"] is not None and len(m["u"]) < 4 or m["U"] is not None and (len(m["U"]) < 8 or int(m["U"], 16) > 0x10FFFF):
            return False
        elif m["N"] is not None:
            try:
                unicodedata.lookup(m["N"][1:-1])
            except KeyError:
                return False
    return True


def _string_kind(text: str) -> str | None:
    """STRING or BYTES; None if its characters or escapes can't be in it."""
    prefix = text[: min(text.find(q) for q in "'\"" if q in text)].lower()
    if "b" in prefix and not text.isascii():
        return None
    if "r" not in prefix and not _escapes_fit(text[len(prefix) :], "b" in prefix):
        return None
    return "BYTES" if "b" in prefix else "STRING"


def python_kinds(text: str) -> list[str] | None:
    if "\0" in text:
        return None
    out: list[str] = []
    soft: list[int] = []
    raw: list[bool] = []  # of the formatted strings around
    last = None
    starts_line = True
    lines = io.StringIO(text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n"))
    try:
        for t in tokenize.generate_tokens(lines.readline):
            kind, before, last = t.type, last, t
            if kind in _SKIP:
                continue
            if kind == tokenize.OP:
                out.append(t.string)
            elif kind == tokenize.NAME:
                if t.string in _KEYWORDS:
                    out.append(t.string)
                else:
                    if starts_line and t.string in ("match", "case", "type"):
                        soft.append(len(out))
                        out.append(t.string)
                        starts_line = False
                        continue
                    out.append("NAME")
            elif kind == tokenize.STRING:
                if (string := _string_kind(t.string)) is None:
                    return None
                out.append(string)
            elif kind in _PLAIN:
                if kind == tokenize.FSTRING_START:
                    raw.append("r" in t.string.lower())
                elif kind == tokenize.FSTRING_END:
                    raw.pop()
                elif kind == tokenize.FSTRING_MIDDLE and not raw[-1] and not _escapes_fit(t.string, False):
                    return None
                elif kind == tokenize.NUMBER and (not _NUMBER.fullmatch(t.string) or before is not None and before.end == t.start and before.type == tokenize.NUMBER):
                    return None
                out.append(_PLAIN[kind])
            else:
                return None
            starts_line = out[-1] in ("NEWLINE", "INDENT", "DEDENT", ";", ":")
    except (tokenize.TokenError, SyntaxError, UnicodeError):
        return None
    for i in soft:  # words that are keywords only where a statement of theirs begins
        depth, colon, j = 0, False, i + 1
        while j < len(out) and out[j] != "NEWLINE":
            depth += (out[j] in "([{") - (out[j] in ")]}") if len(out[j]) == 1 else 0
            colon = colon or out[j] == ":" and depth == 0
            j += 1
        following = out[i + 1] if i + 1 < len(out) else "NEWLINE"
        statement = following not in _AFTER_SOFT and (colon if out[i] != "type" else following == "NAME")
        if not statement:
            out[i] = "NAME"
    return out


# ---- YAML ----

_YAML_BAD = re.compile("[^\t\n\r\x20-\x7e\x85\xa0-퟿-�\U00010000-\U0010ffff]")
_BREAKS = "\n\x85  "
_ENDS = _BREAKS + "\0"
_BLANK = " \t" + _ENDS
_DIRECTIVE = re.compile(r"%(?:YAML +(?P<major>\d+)\.\d+|TAG +(?P<handle>!(?:[-\w]*!)?) +[^\s]+|(?!(?:YAML|TAG)\b)[-\w]+[^\n\x85\u2028\u2029\0]*?) *(?:(?<= )#[^\n\x85\u2028\u2029\0]*)?(?=[\n\x85\u2028\u2029\0])")
_ANCHOR = re.compile(r"[0-9A-Za-z_-]+")
_ESCAPE = re.compile(r'\\(?:[0abtnvfre "/\\N_LP\t]|x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|[\n\x85  ])')


class _NotYaml(Exception):
    pass


class _Yaml:
    """Tokens of a YAML 1.1 stream: structure from indentation, keys found when their ':' comes."""

    def __init__(self, text: str) -> None:
        self.text = text.replace("\r\n", "\n").replace("\r", "\n") + "\0"
        self.pos, self.line, self.line_start = 0, 0, 0
        self.out: list[str] = []
        self.indent, self.indents = -1, []
        self.flow: list[str] = []
        self.handles: set[str | None] = set()  # of tags, declared for this document
        self.version = False
        self.key_allowed = True
        self.keys: dict[int, tuple[int, bool, int, int, int]] = {}  # by flow depth: token, required, pos, line, column

    @property
    def column(self) -> int:
        return self.pos - self.line_start

    def run(self) -> list[str]:
        if self.text.startswith("﻿"):
            self.pos = self.line_start = 1
        while True:
            self.to_next()
            for depth in [d for d, k in self.keys.items() if k[3] != self.line or self.pos - k[2] > 1024]:
                if self.keys.pop(depth)[1]:
                    raise _NotYaml
            self.unwind(self.column)
            c = self.text[self.pos]
            if c == "\0" and self.pos == len(self.text) - 1:
                if self.flow:
                    raise _NotYaml
                self.drop_key()
                self.unwind(-1)
                return self.out
            self.one(c, self.text[self.pos + 1 : self.pos + 2])

    def to_next(self) -> None:
        text = self.text
        while True:
            while text[self.pos] == " ":
                self.pos += 1
            if text[self.pos] == "#" and (self.pos == self.line_start or text[self.pos - 1] in _BLANK + "﻿"):
                while text[self.pos] not in _ENDS:
                    self.pos += 1
            if text[self.pos] in _BREAKS:
                self.newline()
                if not self.flow:
                    self.key_allowed = True
            else:
                return

    def newline(self) -> None:
        self.pos += 1
        self.line += 1
        self.line_start = self.pos

    def unwind(self, column: int) -> None:
        if self.flow:
            return
        while self.indent > column:
            self.indent = self.indents.pop()
            self.out.append("BLOCK_END")

    def push_indent(self, column: int) -> bool:
        if self.indent < column:
            self.indents.append(self.indent)
            self.indent = column
            return True
        return False

    def save_key(self) -> None:
        required = not self.flow and self.indent == self.column
        if self.key_allowed:
            self.drop_key()
            self.keys[len(self.flow)] = (len(self.out), required, self.pos, self.line, self.column)

    def drop_key(self) -> None:
        if (k := self.keys.pop(len(self.flow), None)) and k[1]:
            raise _NotYaml

    def one(self, c: str, after: str) -> None:
        text, start_of_line = self.text, self.column == 0
        if start_of_line and c == "%":
            if self.out[-1:] != ["DIRECTIVE"]:
                self.handles, self.version = set(), False
            self.document_mark("DIRECTIVE")
            m = _DIRECTIVE.match(text, self.pos)
            if m is None or m["major"] and (m["major"] != "1" or self.version) or m["handle"] and m["handle"] in self.handles:
                raise _NotYaml
            self.version = self.version or m["major"] is not None
            self.handles.add(m["handle"])
            self.pos = m.end()
        elif start_of_line and text[self.pos : self.pos + 3] in ("---", "...") and text[self.pos + 3] in _BLANK:
            if self.out[-1:] != ["DIRECTIVE"]:
                self.handles = set()
            self.document_mark("DOC_START" if c == "-" else "DOC_END")
            self.pos += 3
        elif c in "[{":
            self.save_key()
            self.flow.append(c)
            self.key_allowed = True
            self.put(c)
        elif c in "]}":
            self.drop_key()
            if not self.flow:
                raise _NotYaml
            self.flow.pop()
            self.key_allowed = False
            self.put(c)
        elif c == "," and self.flow:
            self.key_allowed = True
            self.drop_key()
            self.put(c)
        elif c == "-" and after in _BLANK:
            if self.flow:
                raise _NotYaml
            if not self.key_allowed:
                raise _NotYaml
            if self.push_indent(self.column):
                self.out.append("SEQ_START")
            self.key_allowed = True
            self.drop_key()
            self.put("ENTRY")
        elif c == "?" and (self.flow or after in _BLANK):
            if not self.flow:
                if not self.key_allowed:
                    raise _NotYaml
                if self.push_indent(self.column):
                    self.out.append("MAP_START")
            self.key_allowed = not self.flow
            self.drop_key()
            self.put("KEY")
        elif c == ":" and (self.flow or after in _BLANK):
            self.value()
        elif c in "*&":
            self.save_key()
            self.key_allowed = False
            m = _ANCHOR.match(text, self.pos + 1)
            if m is None or text[m.end()] not in _BLANK + "?:,]}%@`":
                raise _NotYaml
            self.pos = m.end()
            self.out.append("ALIAS" if c == "*" else "ANCHOR")
        elif c == "!":
            self.save_key()
            self.key_allowed = False
            m = re.compile(r"!<[^>\s]+>|![^\s,\[\]{}]*").match(text, self.pos)
            self.pos = m.end()
            handle = re.match(r"![-\w]+!", m.group())
            if text[self.pos] not in _BLANK or handle and handle.group() not in self.handles:
                raise _NotYaml
            self.out.append("TAG")
        elif c in "|>" and not self.flow:
            self.key_allowed = True
            self.drop_key()
            self.block_scalar()
        elif c in "'\"":
            self.save_key()
            self.key_allowed = False
            self.quoted(c)
        elif c not in _BLANK + "-?:,[]{}#&*!|>'\"%@`" or after not in _BLANK and (c == "-" or not self.flow and c in "?:"):
            self.save_key()
            self.key_allowed = False
            self.plain()
        else:
            raise _NotYaml

    def put(self, kind: str) -> None:
        self.out.append(kind)
        self.pos += 1

    def document_mark(self, kind: str) -> None:
        if self.flow:
            raise _NotYaml
        self.unwind(-1)
        self.drop_key()
        self.key_allowed = False
        self.out.append(kind)

    def value(self) -> None:
        if key := self.keys.pop(len(self.flow), None):
            at = key[0]
            self.out.insert(at, "KEY")
            if not self.flow and self.push_indent(key[4]):
                self.out.insert(at, "MAP_START")
            self.key_allowed = False
        else:
            if not self.flow:
                if not self.key_allowed:
                    raise _NotYaml
                if self.push_indent(self.column):
                    self.out.append("MAP_START")
            self.key_allowed = not self.flow
            self.drop_key()
        self.put("VALUE")

    def block_scalar(self) -> None:
        m = re.compile(r"[|>](?:[+-][1-9]?|[1-9][+-]?)?[ ]*(?:#[^\n\x85  \0]*)?(?=[\n\x85  \0])").match(self.text, self.pos)
        if m is None:
            raise _NotYaml
        head, text = m.group(), self.text
        self.pos = m.end()
        least = max(1, self.indent + 1)
        digit = re.match(r"[|>][+-]?([1-9])", head)
        if text[self.pos] in _BREAKS:
            self.newline()
        if digit:
            indent = least + int(digit.group(1)) - 1
        else:
            most, at = 0, self.pos
            while text[at] in " " + _BREAKS:
                if text[at] == " ":
                    run = re.compile(" *").match(text, at).end()
                    most, at = max(most, run - at), run
                else:
                    at += 1
            indent = max(least, most)
        while True:
            run = re.compile(" *").match(text, self.pos).end()
            if text[run] in _BREAKS and run - self.pos <= indent:
                self.pos = run
                self.newline()
                continue
            if run - self.pos < indent or text[run] == "\0" and run == len(text) - 1:
                self.pos = min(run, self.pos + indent)
                break
            while text[self.pos] not in _ENDS:
                self.pos += 1
            if text[self.pos] not in _BREAKS:
                break
            self.newline()
        self.out.append("SCALAR")

    def quoted(self, q: str) -> None:
        text = self.text
        self.pos += 1
        while True:
            c = text[self.pos]
            if c == q:
                if q == "'" and text[self.pos + 1] == "'":
                    self.pos += 2
                    continue
                self.pos += 1
                break
            if c == "\\" and q == '"':
                m = _ESCAPE.match(text, self.pos)
                if m is None:
                    raise _NotYaml
                if m.group()[-1] in _BREAKS:
                    self.pos += 1
                    self.newline()
                    self.no_mark()
                else:
                    self.pos = m.end()
            elif c in _BREAKS:
                self.newline()
                self.no_mark()
            elif c == "\0":
                raise _NotYaml
            else:
                self.pos += 1
        self.out.append("SCALAR")

    def no_mark(self) -> None:
        if self.text[self.pos : self.pos + 3] in ("---", "...") and self.text[self.pos + 3] in _BLANK:
            raise _NotYaml

    def plain(self) -> None:
        text, indent = self.text, self.indent + 1
        while True:
            start = self.pos
            if text[self.pos] == "#":
                break
            while True:
                c = text[self.pos]
                if c in _BLANK or c == ":" and text[self.pos + 1] in _BLANK + (",[]{}" if self.flow else "") or self.flow and c in ",?[]{}":
                    break
                self.pos += 1
            if self.pos == start:
                break
            self.key_allowed = False
            end = self.pos
            while text[self.pos] == " ":
                self.pos += 1
            spaces = self.pos > end
            if text[self.pos] in _BREAKS:
                spaces = True
                self.newline()
                self.key_allowed = True
                marked = False
                while text[self.pos] in " " + _BREAKS:
                    if text[self.pos] == " ":
                        self.pos += 1
                    else:
                        self.newline()
                    marked = marked or text[self.pos : self.pos + 3] in ("---", "...") and self.pos == self.line_start and text[self.pos + 3] in _BLANK
                if marked or self.pos == self.line_start and text[self.pos : self.pos + 3] in ("---", "...") and text[self.pos + 3] in _BLANK:
                    break
            if not spaces or text[self.pos] == "#" or not self.flow and self.column < indent:
                break
        self.out.append("SCALAR")


def yaml_kinds(text: str) -> list[str] | None:
    if _YAML_BAD.search(text.removeprefix("﻿")):
        return None
    try:
        return _Yaml(text).run()
    except (_NotYaml, IndexError):
        return None


# ---- PHP ----


_EQUAL, _COMPARE = frozenset(("==", "!=", "<>", "===", "!==", "<=>")), frozenset(("<", "<=", ">", ">="))
#: What may stand between two operators of one kind without ending the chain: operands, and operators that bind closer.
_CLOSER = frozenset("+ - * / % . ** << >> ! ~ @ CAST ++ -- -> ?-> :: instanceof new clone NAME QNAME VAR INT FLOAT STR MAGIC static $ isset empty ENC_VAR array list \\ class".split())
_LOWER_THAN_TERNARY = frozenset("& | ^ && || ??".split())


def _chains(kinds: list[str]) -> bool:
    """Whether no two comparisons, and no two ternaries, stand in one chain without brackets, which PHP has no reading for."""
    # of each open bracket: an equality was seen, a comparison was, and of each open ternary the kind of the one that ended
    levels = [[False, False, [""]]]
    for i, k in enumerate(kinds):
        level = levels[-1]
        if k in _EQUAL:
            if level[0]:
                return False
            level[0], level[1] = True, False
        elif k in _COMPARE:
            if level[1]:
                return False
            level[1] = True
        elif k in ("(", "[", "{", "#[", "ENC_OPEN", "DQ_OPEN"):
            levels.append([False, False, [""]])
        elif k in (")", "]", "}", "ENC_CLOSE", "DQ_CLOSE"):
            if len(levels) > 1:
                levels.pop()
        elif k == "?":
            level[0] = level[1] = False
            kind, ended = "short" if kinds[i + 1 : i + 2] == [":"] else "full", level[2][-1]
            if ended and (ended, kind) != ("short", "short"):
                return False
            level[2].append(kind)
            level[2].append("")
        elif k == ":":
            level[0] = level[1] = False
            if len(level[2]) > 1:
                level[2].pop()
                level[2][-2:] = [level[2][-1]]
            else:
                level[2] = [""]
        elif k in _LOWER_THAN_TERNARY:
            level[0] = level[1] = False
        elif k not in _CLOSER:
            level[0] = level[1] = False
            level[2] = [""]
    return True


def php_kinds(text: str) -> list[str] | None:
    """None also for a text without any opening tag, and for casts that the language has no more."""
    lexer = php_lexer.Lexer(text)
    found = lexer.run()
    kinds = [k for k, _, _ in found]
    if not lexer.opened or "BAD" in kinds[-1:] or any(k == "CAST" and t[1:-1].strip(" \t").lower() in ("unset", "real") for k, t, _ in found):
        return None
    return kinds if _chains(kinds) else None

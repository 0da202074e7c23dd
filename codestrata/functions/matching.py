"""Predicates over paths, namespaces, rule names and channels, and glob patterns with captures, as Spark columns."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_of(conditions: Iterable[Column]) -> Column:
    """OR of conditions, false for none; a null condition counts as false."""
    return reduce(lambda a, b: a | b, (F.coalesce(c, F.lit(False)) for c in conditions), F.lit(False))


def glob_regex(pattern: str, separator: str | None = None) -> str:
    """A shell glob as a regular expression for whole strings. `*` and `?` also match separators unless one is given."""
    one = f"[^{re.escape(separator)}]" if separator else "(?s:.)"
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            if separator and pattern[i : i + 1] == "*":
                i += 1
                out.append("(?s:.*)")
            else:
                out.append(one + "*")
        elif c == "?":
            out.append(one)
        elif c == "[" and (end := pattern.find("]", i + 1)) > 0:
            body = pattern[i:end].replace("\\", "\\\\").replace("[", "\\[")
            out.append("[" + ("^" + body[1:] if body[:1] in ("!", "^") else body) + "]")
            i = end + 1
        else:
            out.append(re.escape(c))
    return "^" + "".join(out) + "$"


def _is_glob(pattern: str) -> bool:
    return any(c in pattern for c in "*?[")


def path_matches(path: Column, patterns: Iterable[str]) -> Column:
    """Exact path, directory prefix (on a `/` boundary), or glob."""
    out = []
    for p in patterns:
        p = p.rstrip("/")
        out.append(path.rlike(glob_regex(p)) if _is_glob(p) else (path == p) | path.startswith(p + "/"))
    return any_of(out)


def namespace_matches(namespace: Column, patterns: Iterable[str]) -> Column:
    """Exact namespace, prefix on a backslash boundary, or glob; the empty pattern matches nothing."""
    out = []
    for p in patterns:
        p = p.strip("\\")
        if p:
            out.append(namespace.rlike(glob_regex(p)) if _is_glob(p) else (namespace == p) | namespace.startswith(p + "\\"))
    return any_of(out)


def name_selected(name: Column, selector: str) -> Column:
    """`a.b` selects itself and what is below it, `a.b.*` only what is below."""
    if selector.endswith(".*"):
        return name.startswith(selector[:-1])
    return (name == selector) | name.startswith(selector + ".")


def channel_selected(channel: Column, selector: str) -> Column:
    """A `rule#code` pair selects that channel, a name the channels whose code it selects."""
    if "#" in selector:
        return channel == selector
    return name_selected(F.substring_index(channel, "#", -1), selector)


def selected(channel: Column, only: Iterable[str] = (), disabled: Iterable[str] = ()) -> Column:
    """Gate of channels: those of `only` (all, if it is empty) without those of `disabled`. Rules count by their name."""

    def hit(s: str) -> Column:
        return channel_selected(channel, s) | name_selected(F.substring_index(channel, "#", 1), s)

    only = list(only)
    return (any_of(map(hit, only)) if only else F.lit(True)) & ~any_of(map(hit, disabled))


def capture(text: Column, pattern: str) -> Column:
    """Bindings of a pattern such as `App\\{module}\\**`, a map from variable to text; null where it doesn't match.

    `{name}` takes one segment, `*` part of a segment, `**` anything.
    """
    names = re.findall(r"\{([A-Za-z_]\w*)\}", pattern)
    parts = re.split(r"\{[A-Za-z_]\w*\}", pattern)
    regex = r"([^\\]+)".join(glob_regex(p, "\\")[1:-1] for p in parts)
    pairs = [x for i, n in enumerate(names) for x in (F.lit(n), F.regexp_extract(text, f"^{regex}$", i + 1))]
    bound = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return F.when(text.rlike(f"^{regex}$"), bound)


def substitute(template: str, bindings: Column) -> Column:
    """A template with its `{name}`s replaced from a map."""
    out = F.lit(template)
    for n in re.findall(r"\{([A-Za-z_]\w*)\}", template):
        out = F.replace(out, F.lit("{" + n + "}"), bindings[n])
    return out


# fixed values: the names of the language's own classes, as patterns over families of names
_BUILTIN = "|".join((
    r"(Logic|BadFunctionCall|BadMethodCall|Domain|InvalidArgument|Length|OutOfRange|Runtime|OutOfBounds|Overflow|Range|Underflow|UnexpectedValue|Json|ClosedGenerator|Error|PDO|RequestParseBody)?Exception",
    r"(Arithmetic|DivisionByZero|Assertion|Compile|Parse|Type|ArgumentCount|Value|UnhandledMatch|Fiber)?Error",
    r"stdClass|Closure|Generator|Fiber|WeakReference|WeakMap|Throwable|Stringable|ArrayAccess|Countable|Serializable|JsonSerializable|Traversable|BackedEnum|UnitEnum",
    r"Attribute|AllowDynamicProperties|Override|SensitiveParameter(Value)?|ReturnTypeWillChange|Deprecated|NoDiscard|Directory|StreamBucket|php_user_filter|__PHP_Incomplete_Class|PropertyHookType|RoundingMode|DelayedTargetValidation",
    r"(Append|Array|Caching|CallbackFilter|Directory|Empty|Filesystem|Filter|Glob|Infinite|Internal|Iterator|Limit|Multiple|NoRewind|Outer|Parent|Recursive(Array|Caching|CallbackFilter|Directory|Filter|Iterator|Regex|Tree)?|Regex|Seekable)?Iterator|IteratorAggregate",
    r"ArrayObject|Spl(DoublyLinkedList|FixedArray|(Max|Min)?Heap|ObjectStorage|PriorityQueue|Queue|Stack|(Temp)?FileObject|FileInfo|Observer|Subject)",
    r"Date(Time(Immutable|Interface|Zone)?|Interval|Period|Error|Exception|(Object|Range)Error|Invalid(Operation|TimeZone)Exception|Malformed(IntervalString|PeriodString|String)Exception)",
    r"Reflection[A-Za-z]*|Reflector|PDO(Statement|Row)?|(Random|Dom|Filter|Pdo)\\.+",
))
BUILTIN = rf"^\\?({_BUILTIN})$"


def is_builtin(name: Column) -> Column:
    """Whether a name, with or without a leading backslash, is one of the language's own classes; false for null."""
    return F.coalesce(name.rlike(BUILTIN), F.lit(False))


def under(name: Column, prefixes: Iterable[str]) -> Column:
    """Whether a class is in one of the namespaces `prefixes` or below; false for null names and no prefixes."""
    return any_of([F.startswith(name, F.lit(p.strip("\\") + "\\")) for p in prefixes])

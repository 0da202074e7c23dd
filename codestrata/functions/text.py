"""Line counts, markers and sensitive names in source text, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that are credentials, qualifiers that make `key` and `token` ones, and words behind or before which
# a name isn't one
SENSITIVE_WORDS = ("password", "passwd", "pwd", "secret", "credential", "credentials")
KEY_QUALIFIERS = ("api", "secret", "private", "encryption", "signing", "auth", "access")
TOKEN_QUALIFIERS = ("auth", "access", "bearer", "api", "refresh", "jwt")
HARMLESS_AFTER = (
    "field", "column", "name", "label", "type", "length", "hash", "reset", "policy", "manager", "service", "provider", "format", "pattern", "regex", "rule", "input",
    "param", "header", "validator", "checker", "encoder", "hasher", "min", "max", "expiry", "expires", "lifetime", "timeout", "prefix", "suffix", "path", "url", "file",
    "storage", "handler", "factory", "builder", "generator", "upgrader", "verifier", "extractor", "error", "option", "config", "setting", "strength",
)
HARMLESS_BEFORE = (
    "option", "config", "setting", "reset", "type", "error", "invalid", "event", "subject", "name", "field", "column", "url", "path", "cache", "storage", "format", "min",
    "max", "default", "hashed", "encoded", "is", "has", "can", "should", "needs", "requires",
)


def lines_of(text: Column) -> Column:
    """The pieces between line feeds; a final line feed adds an empty one."""
    return F.split(text, "\n", -1)


def is_blank(line: Column) -> Column:
    return line.rlike(r"^\s*$")


def is_comment(line: Column) -> Column:
    """A line that holds nothing but a comment or a part of one, by its beginning: //, #, /*, * or */."""
    return line.rlike(r"^\s*(//|#($|[^\[])|/\*|\*)")


def line_counts(text: Column) -> Column:
    """struct(loc, blank, cloc, lloc): all lines, blank ones, pure comment lines, and the rest. 0s for a null text."""
    lines = lines_of(F.coalesce(text, F.lit("")))
    known = text.isNotNull().cast("int")
    loc = F.size(lines) * known
    blank = F.size(F.filter(lines, is_blank)) * known
    cloc = F.size(F.filter(lines, lambda x: is_comment(x) & ~is_blank(x))) * known
    return F.struct(loc.alias("loc"), blank.alias("blank"), cloc.alias("cloc"), (loc - blank - cloc).alias("lloc"))


def is_generated(text: Column) -> Column:
    """Whether a comment in the first 2048 characters carries the marker @generated, in any case."""
    return F.coalesce(F.substring(text, 1, 2048).rlike(r"(?im)(^\s*(//|#|/\*|\*)|/\*).*@generated\b"), F.lit(False))


def name_words(name: Column) -> Column:
    """camelCase, PascalCase and snake_case names as lower-case words."""
    snake = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2"), r"([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.filter(F.split(F.lower(snake), r"[_\W]+"), lambda w: w != "")


def is_sensitive_name(name: Column) -> Column:
    """Whether a word of a name is a credential's, or key or token behind a qualifier, with no harmless word anywhere
    behind or before it. False for null and empty names."""
    words = name_words(name)

    def at(i: Column) -> Column:
        word, before = F.get(words, i), F.get(words, i - 1)
        own = word.isin(*SENSITIVE_WORDS) | ((word == "key") & before.isin(*KEY_QUALIFIERS)) | ((word == "token") & before.isin(*TOKEN_QUALIFIERS))
        behind = F.exists(F.slice(words, i + 2, F.size(words)), lambda w: w.isin(*HARMLESS_AFTER))
        ahead = F.exists(F.slice(words, F.lit(1), i), lambda w: w.isin(*HARMLESS_BEFORE))
        return F.coalesce(own, F.lit(False)) & ~behind & ~ahead

    return F.when(F.size(words) > 0, F.exists(F.sequence(F.lit(0), F.size(words) - 1), at)).otherwise(F.lit(False))

"""Source files that their language does not accept."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm import grammars, lexers
from codestrata.llm.gll import Grammar

#: Ends of paths, in lower case, and the language that they mean; fixed by the problem's statement.
ENDS = {
    ".php": "php", ".inc": "php", ".phtml": "php", ".py": "python", ".json": "json", ".json.dist": "json",
    ".yaml": "yaml", ".yml": "yaml", ".xml": "xml", ".xml.dist": "xml",
}
#: Of each language: its lexer, its grammar, and the rule of a whole file; its dialects are in the grammars' DIALECTS.
LANGUAGES = {
    "php": (lexers.php_kinds, "PHP", "file"),
    "python": (lexers.python_kinds, "PYTHON", "file"),
    "json": (lexers.json_kinds, "JSON", "value"),
    "yaml": (lexers.yaml_kinds, "YAML", "stream"),
    "xml": (lexers.xml_kinds, "XML", "document"),
}


def language_of(path: Column) -> Column:
    """The language that a path's end means, in any case; null for other and null paths."""
    low = F.lower(path)
    out = F.lit(None).cast("string")
    for end, language in ENDS.items():
        out = F.when(low.endswith(end), language).otherwise(out)
    return out


@lru_cache(maxsize=None)
def _grammar(language: str) -> Grammar:
    return Grammar(getattr(grammars, LANGUAGES[language][1]), grammars.DIALECTS[language])


def parse(text: str, language: str) -> tuple[tuple[str, ...], int, int]:
    """(the dialects that derive the text, its tokens, how many of them could be read); no tokens if none can be made."""
    kinds_of, _, start = LANGUAGES[language]
    kinds = kinds_of(text)
    if kinds is None:
        return (), 0, 0
    accepted, reached = _grammar(language).parse(kinds, start)
    return accepted, len(kinds), reached


def check_syntax(docs: DataFrame, id_column: str = "doc_id", path_column: str = "path", text_column: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """One row per file of a known language with a text: the id, the columns `keep`, `language`, `valid`, `dialects` (those
    that accept it), `tokens`, `tokens_read`.

    Files whose path is null or of no known language, and null or blank texts, give no rows. `tokens` is 0 where not
    even tokens can be made (an open string or comment, no opening tag in a PHP file). Repeated rows and copies are each
    checked. Texts of any length are read whole, in time in proportion to their length; a stack is held for what is
    open, not for what has been read. Other columns are not read. An empty table gives an empty table.

    Files are parsed where they lie, by generalised LL over a graph-structured stack, all dialects of a language at
    once; a file is invalid if every dialect rejects it.
    """
    kept = [f"k{i}" for i in range(len(keep))]
    files = docs.select(
        F.col(id_column).alias("id"), *[F.col(c).alias(k) for c, k in zip(keep, kept)], language_of(F.col(path_column)).alias("language"), F.col(text_column).alias("text")
    )
    files = files.where(F.col("language").isNotNull() & F.col("text").rlike(r"(?U)\S"))
    types = {c: docs.schema[c].dataType.simpleString() for c in (id_column, *keep)}
    names = ["id", *kept, "language", "valid", "dialects", "tokens", "tokens_read"]
    schema = ", ".join([f"id {types[id_column]}", *[f"{k} {types[c]}" for c, k in zip(keep, kept)], "language string, valid boolean, dialects array<string>, tokens int, tokens_read int"])

    def checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for *others, language, text in batch.itertuples(index=False):
                dialects, tokens, read = parse(text, language)
                rows.append((*others, language, bool(dialects), list(dialects), tokens, read))
            yield pd.DataFrame(rows, columns=names)

    out = files.mapInPandas(checked, schema)
    return out.select(F.col("id").alias(id_column), *[F.col(k).alias(c) for c, k in zip(keep, kept)], *names[1 + len(kept) :])


def rates(checked: DataFrame, repo_column: str = "repo") -> DataFrame:
    """Per repository and language of `checked` files (which keep `repo_column`): `files`, `invalid`, `rate`. A null
    repository is a group of its own."""
    groups = checked.groupBy(repo_column, "language")
    return groups.agg(F.count("*").alias("files"), F.count_if(~F.col("valid")).alias("invalid"), F.avg(F.when(F.col("valid"), 0.0).otherwise(1.0)).alias("rate"))

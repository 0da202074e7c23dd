"""Duplicated runs of tokens."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codestrata.session import cut

# every repetition is of single characters or of pairs: the JVM repeats other groups by recursion, and long texts overflow
_COMMENT = r"//[^\n]*|#(?!\[)[^\n]*|/\*[\s\S]*?(?:\*/|\z)"
_STRINGS = "|".join(rf"{q}(?:\\\\)*{q}|{q}[^\n]*?[^\\\n](?:\\\\)*{q}" for q in "\"'")
_SPLIT = rf"{_COMMENT}|#\[|\$[A-Za-z_]\w*|[A-Za-z_]\w*|[0-9][0-9a-zA-Z_.]*|{_STRINGS}|\S"


def normal_tokens(text: Column) -> Column:
    """Tokens of source text without comments, with variables as $_, strings as '_' and numbers as 0."""
    words = F.filter(F.regexp_extract_all(text, F.lit(_SPLIT), F.lit(0)), lambda w: ~w.rlike(r"^(//|#(?!\[)|/\*)"))
    return F.transform(words, lambda w: F.when((w.startswith("$")) & (F.length(w) > 1), "$_").when(w.rlike("^[\"'](?s:.*)[\"']$") & (F.length(w) > 1), "'_'").when(w.rlike("^[0-9]"), "0").otherwise(w))


def copies(files: DataFrame, k: int) -> DataFrame:
    """`files` (`file`, `tokens`) of at least `k` tokens with `representative`, the smallest file of equal tokens.

    Clones need only be looked for between representatives; a class of copies is one row a file here, not a pair of every
    two of them.
    """
    content = F.sha2(F.array_join("tokens", "\x1f"), 256).alias("content")
    named = files.where(F.size("tokens") >= k).select("file", content)
    first = named.groupBy("content").agg(F.min("file").alias("representative"), F.count("*").alias("files"))
    return named.join(first, "content").select("file", "representative", "files")


def representatives(files: DataFrame, k: int) -> DataFrame:
    """One of each class of equal token lists among `files`; shorter ones than `k` are left out."""
    return files.join(copies(files, k).where("file = representative").select("file"), "file", "left_semi")


def windows(files: DataFrame, k: int) -> DataFrame:
    """`files` (`file`, `tokens`) to `file`, `pos`, `hash` of each run of `k` tokens; shorter files give none. `before` and
    `after` are hashes of the tokens beside the run; at the border of a file they are its own, equal to no other."""
    long = files.where(F.size("tokens") >= k).select("file", F.transform("tokens", lambda t: F.xxhash64(t)).alias("tokens"))
    at = F.sequence(F.lit(0), F.size("tokens") - k)
    hash_of = lambda i: F.struct(F.xxhash64(F.slice("tokens", i + 1, F.lit(k))), F.xxhash64(F.lit(1), F.slice("tokens", i + 1, F.lit(k))))  # 128 bits
    beside = lambda i: F.get("tokens", i)
    each = F.transform(at, lambda i: F.struct(hash_of(i).alias("hash"), beside(i - 1).alias("before"), beside(i + k).alias("after")))
    # an inner posexplode would have Spark hash everything twice, for a filter on the number of windows
    spread = long.select("file", F.posexplode_outer(each).alias("pos", "w")).where("pos IS NOT NULL").select("file", "pos", "w.*")
    return spread.select("file", "pos", "hash", *[F.coalesce(c, F.xxhash64(F.lit(c), "file", "pos")).alias(c) for c in ("before", "after")])


def clone_pairs(files: DataFrame, k: int = 70) -> DataFrame:
    """Maximal equal runs of at least `k` tokens: `a_file`, `a_pos`, `b_file`, `b_pos`, `tokens`.

    A run begins where equal windows have different tokens before them and ends where they have different ones after
    them; on each diagonal (two files, difference of positions) a beginning and the end that follows it are one clone. So
    windows are paired only at the two ends of a run, places that share the token beside them never, and no window is
    too frequent: there are two rows for each run. Runs of one file that overlap themselves are dropped. Equal hashes
    of different windows can't be told apart here; with 128 bits they are not to be expected in any corpus.
    """
    all_windows = windows(files, k)
    differ = [(F.min(c) < F.max(c)).alias(f"{c}_differ") for c in ("before", "after")]
    borders = all_windows.groupBy("hash").agg(*differ).where("before_differ OR after_differ")
    sides = [F.when(F.col(f"{c}_differ"), F.struct(F.lit(c == "after").alias("last"), F.col(c).alias("beside"))) for c in ("before", "after")]
    ends = cut(all_windows.join(borders, "hash").select("hash", "file", "pos", F.explode(F.filter(F.array(*sides), lambda x: x.isNotNull())).alias("s")).select("hash", "s.*", "file", "pos"))
    others = ends.select("hash", "last", F.col("beside").alias("other")).distinct()
    a = ends.join(others, ["hash", "last"]).where("beside < other").select("hash", "last", "other", F.struct("file", "pos").alias("x"))
    b = ends.select("hash", "last", F.col("beside").alias("other"), F.struct("file", "pos").alias("y"))
    pairs = a.join(b, ["hash", "last", "other"]).select("last", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    marks = pairs.select(F.col("a.file").alias("a_file"), F.col("a.pos").alias("a_pos"), F.col("b.file").alias("b_file"), F.col("b.pos").alias("b_pos"), "last", (F.col("b.pos") - F.col("a.pos")).alias("shift"))
    diagonal = Window.partitionBy("a_file", "b_file", "shift").orderBy("a_pos", "last")
    runs = marks.withColumn("tokens", F.lead("a_pos").over(diagonal).cast("long") - F.col("a_pos") + k).where("NOT last")
    return runs.where((F.col("a_file") != F.col("b_file")) | (F.col("shift") >= F.col("tokens"))).select("a_file", "a_pos", "b_file", "b_pos", "tokens")


# fixed values: the tokens of tables of constants
DATA = ("'_'", "0", "[", "]", "(", ")", ",", "=>", "array", "const", "=", ";", "-", "null", "true", "false", "return", "static", "private", "public", "protected")


def verified(pairs: DataFrame, files: DataFrame, keep_data: bool = False) -> DataFrame:
    """`pairs` without those that are nothing but tables of constants (both sides are, being equal). With `lines` in `files`
    also `lines`, how many lines the second copy spans. Each place is looked at once, however many pairs it is in."""
    some = "lines" in files.columns
    size = F.col("tokens").cast("int")
    texts = files.select(F.col("file").alias("b_file"), F.col("tokens").alias("_t"), *([F.col("lines").alias("_l")] if some else []))
    places = pairs.select("b_file", "b_pos", "tokens").distinct().join(texts, "b_file")
    span = [(F.get("_l", (F.col("b_pos") + size - 1).cast("int")) - F.get("_l", F.col("b_pos")) + 1).alias("lines")] if some else []
    data = ~F.exists(F.slice("_t", F.col("b_pos") + 1, size), lambda t: ~F.lower(t).isin(*DATA))
    known = places.select("b_file", "b_pos", "tokens", data.alias("_data"), *span)
    rows = pairs.join(known, ["b_file", "b_pos", "tokens"])
    return (rows if keep_data else rows.where("NOT _data")).select(*pairs.columns, *(["lines"] if some else []))


def clone_blocks(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """One row per duplicated content: `block` (its identity), `tokens`, `places` (sorted structs of file and pos)."""
    ends = F.array(*[F.struct(F.col(f"{x}_file").alias("file"), F.col(f"{x}_pos").alias("pos")) for x in "ab"])
    sides = pairs.select(F.explode(ends).alias("s"), "tokens").select("s.*", "tokens").distinct()
    texts = files.select("file", F.col("tokens").alias("all_tokens"))
    ident = F.sha2(F.concat_ws("\x1f", F.col("tokens").cast("string"), F.array_join(F.slice("all_tokens", F.col("pos") + 1, F.col("tokens").cast("int")), "\x1f")), 256)
    named = sides.join(texts, "file").select("file", "pos", "tokens", F.substring(ident, 1, 16).alias("block"))
    return named.groupBy("block", "tokens").agg(F.array_sort(F.collect_set(F.struct("file", "pos"))).alias("places"))


def greedy_cover(blocks: DataFrame) -> DataFrame:
    """Blocks in descending size without those whose places all lie inside places of blocks kept before.

    The outcome depends on order, so it is decided per group of blocks that share a file with each other; `group` must
    say which (connected components of blocks and files). A group is a set of near copies; its blocks are one task.
    """

    def cover(group: pd.DataFrame) -> pd.DataFrame:
        taken: dict[str, list[tuple[int, int]]] = {}
        keep = []
        for i, row in group.sort_values(["tokens", "block"], ascending=[False, True]).iterrows():
            spans = [(p["file"], p["pos"], p["pos"] + row["tokens"]) for p in row["places"]]
            if all(any(s <= a and b <= e for s, e in taken.get(f, ())) for f, a, b in spans):
                continue
            keep.append(i)
            for f, a, b in spans:
                taken.setdefault(f, []).append((a, b))
        return group.loc[keep]

    return blocks.groupBy("group").applyInPandas(cover, blocks.schema)

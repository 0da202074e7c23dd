"""Encoding a corpus with a public tokenizer through a table of distinct words, and decoding it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from codestrata.llm import vocabulary
from codestrata.session import cut

#: The most frequent words, so many at most and each of HEAD_CHARS characters at most, are sent to every task, and the
#: most frequent longer ones, such as separator lines: under 20 MB and 16 MB however large the corpus is. All other
#: words meet their ids in a shuffle.
HEAD_WORDS, HEAD_CHARS = 65_536, 48
LONG_WORDS, LONG_CHARS = 512, 2048
#: Pieces are decoded in blocks of so many, so that no task holds those of a huge list one by one.
BLOCK = 4096
#: Java knows the categories of older Unicode; a text with a code point that is unassigned there is split in Python.
_UNKNOWN = r"\p{Cn}"


@F.pandas_udf(ArrayType(StringType()))
def _split_in_python(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: vocabulary.split_words(t) if t is not None else None)


def words_of(text: Column) -> Column:
    """The pieces into which the vocabulary's pattern splits `text`; they concatenate to the text."""
    return F.regexp_extract_all(text, F.lit(f"(?U){vocabulary.PATTERN}"), F.lit(0))


def split_texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(`row`, `id`, `words`): the words of each text in order; none for a null or empty text. `row` numbers the rows."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    odd = rows.withColumn("odd", F.when(F.col("text").rlike(_UNKNOWN), F.col("text")))
    return odd.select("row", "id", F.when(F.col("odd").isNotNull(), _split_in_python("odd")).otherwise(words_of(F.col("text"))).alias("words"))


def word_table(split: DataFrame, path: str) -> DataFrame:
    """(`word`, `uses`, `ids`): each distinct word of `split`, encoded once."""

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(ids=[vocabulary.encode_word(w, path) for w in batch["word"]])

    # an inner explode would have Spark add a filter on the size of `words`, and so split every text twice
    distinct = split.select(F.explode_outer("words").alias("word")).where("word IS NOT NULL").groupBy("word").agg(F.count("*").alias("uses"))
    return distinct.mapInPandas(encoded, "word string, uses bigint, ids array<int>")


def frequent(table: DataFrame) -> DataFrame:
    """The rows of a word table that are sent to every task: those with at least 2^k uses, for the least k at which no
    more than HEAD_WORDS short and LONG_WORDS long ones are. Then each short word that is left has less than
    2 / HEAD_WORDS of all uses, and each long one less than 2 / LONG_WORDS. Only a histogram goes to the driver."""
    size = F.length("word")
    sort = F.when(size <= HEAD_CHARS, 0).when((size <= LONG_CHARS) & (F.col("uses") > 1), 1)
    marked = table.withColumn("sort", sort).where("sort IS NOT NULL").withColumn("power", F.floor(F.log2("uses")).cast("int"))
    counts = {(r["sort"], r["power"]): r["n"] for r in marked.groupBy("sort", "power").agg(F.count("*").alias("n")).collect()}
    keep = F.lit(False)
    for which, most in ((0, HEAD_WORDS), (1, LONG_WORDS)):
        held, least = 0, None
        for power in sorted((p for s, p in counts if s == which), reverse=True):
            held += counts[which, power]
            if held > most:
                break
            least = power
        if least is not None:
            keep = keep | ((F.col("sort") == which) & (F.col("power") >= least))
    return marked.where(keep).select("word", "ids")


def _look_up(head: Broadcast):
    """Batches of (row, id, words) to (row, id, runs, rest): `rest` has the words that the head hasn't, `runs` the ids
    before, between and behind them."""

    def looked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, first, values = head.value
        for batch in batches:
            lists = batch.column("words")
            words = lists.flatten()
            ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False)
            missed = np.flatnonzero(at < 0)
            sizes = np.where(at < 0, 0, first[at + 1] - first[at])
            upto = np.concatenate(([0], np.cumsum(sizes)))  # ids before each word
            ids = values[np.repeat(first[at] - upto[:-1], sizes) + np.arange(upto[-1])] if len(words) else values[:0]
            stops = np.sort(np.concatenate((missed * 2 + 1, ends * 2)))  # a run ends at a missed word or with its text
            before = np.searchsorted(missed, ends)  # missed words up to the end of each text
            runs = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], upto[stops // 2])), pa.int32()), pa.array(ids, pa.int32()))
            texts = np.concatenate(([0], before + np.arange(1, len(ends) + 1)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"), batch.column("id"), pa.ListArray.from_arrays(pa.array(texts, pa.int32()), runs),
                    pa.ListArray.from_arrays(pa.array(np.concatenate(([0], before)), pa.int32()), words.take(pa.array(missed))),
                ],
                ["row", "id", "runs", "rest"],
            )

    return looked


def encode(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None) -> DataFrame:
    """`id_column` and `ids` (array<int>) of each row, without special tokens.

    Null and empty texts have the empty list; strings of special tokens are ordinary text. Rows are told apart by their
    place, not by their ids: rows that repeat an id or are repeated whole each give a row. A null id is an id. An empty
    table gives an empty table. Other columns of `docs` are not read, so none of their names can clash.

    Words are split in Spark, each distinct word is encoded once, and ids are joined back by position: frequent words
    from a broadcast of bounded size, the others through a shuffle in which no word is frequent. Texts are read twice:
    for the table of words, and for the ids.
    """
    path = path or vocabulary.default_path()
    spark, kind = docs.sparkSession, docs.schema[id_column].dataType.simpleString()
    split = split_texts(docs, id_column, text_column)
    table = cut(word_table(split, path))
    head = frequent(table).toArrow()
    lengths = pc.list_value_length(head["ids"]).to_numpy()
    known = head["word"].combine_chunks() if head.num_rows else pa.array([], pa.string())
    sent = spark.sparkContext.broadcast((known, np.concatenate(([0], np.cumsum(lengths, dtype=np.int64))), np.array(head["ids"].combine_chunks().flatten(), np.int32)))
    looked = split.mapInArrow(_look_up(sent), f"row bigint not null, id {kind}, runs array<array<int>>, rest array<string>").repartition("row")

    # both uses of `looked` name all its columns and filter none, so that it is one shuffle, written once
    some = F.col("id").isNull() | (F.size("runs") > 1)
    asked = looked.select("row", F.posexplode_outer(F.when(some, F.col("rest"))).alias("pos", "word")).where("word IS NOT NULL")
    found = asked.join(table.select("word", "ids"), "word").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("found"))
    joined = looked.join(found, "row", "left")
    whole = F.flatten(F.transform("runs", lambda run, i: F.concat(run, F.coalesce(F.get("found", i)["ids"], F.array().cast("array<int>")))))
    complete = F.coalesce(F.size("found"), F.lit(0)) == F.size("rest")  # else the rows of `docs` came in another order
    return joined.select(F.col("id").alias(id_column), F.when(complete, whole).otherwise(F.raise_error(F.lit("words without ids"))).alias("ids"))


def pieces(spark, path: str | None = None) -> DataFrame:
    """(`piece_id`, `piece` binary): the vocabulary as a table; its size is the vocabulary's, 50 thousand rows."""
    table = vocabulary.ranks(path or vocabulary.default_path())
    return spark.createDataFrame(pd.DataFrame({"piece_id": list(table.values()), "piece": list(table)}), "piece_id int, piece binary")


def decode(encoded: DataFrame, id_column: str = "doc_id", ids_column: str = "ids", path: str | None = None) -> DataFrame:
    """`id_column` and `text` of each list of ids: the pieces of the ids, in order, as UTF-8. A null or empty list gives ''.

    Ids that the vocabulary doesn't have give nothing. Bytes that aren't UTF-8 (of lists cut inside a character) become
    the replacement character.
    """
    rows = encoded.select(F.col(id_column).alias("id"), F.posexplode_outer(ids_column).alias("pos", "piece_id"))
    named = rows.join(F.broadcast(pieces(encoded.sparkSession, path)), "piece_id", "left")
    hexed = named.groupBy("id", F.expr(f"coalesce(pos, 0) div {BLOCK}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", F.hex("piece").alias("h")))).alias("at"))
    parts = hexed.select("id", "block", F.array_join(F.transform("at", lambda x: x["h"]), "").alias("h"))
    whole = parts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("block", "h"))).alias("at"))
    return whole.select(F.col("id").alias(id_column), F.make_valid_utf8(F.unhex(F.array_join(F.transform("at", lambda x: x["h"]), "")).cast("string")).alias("text"))


def token_counts(docs: DataFrame, text_column: str = "text", path: str | None = None, name: str = "tokens") -> DataFrame:
    """`docs` with a column of how many tokens the text has; 0 for null and empty texts. Nothing is shuffled."""
    path = path or vocabulary.default_path()

    @F.pandas_udf(LongType())
    def counted(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(vocabulary.encode(t, path)) if t else 0).astype("int64")

    return docs.withColumn(name, counted(F.col(text_column)))

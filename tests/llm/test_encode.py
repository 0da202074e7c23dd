import random

import pytest

from codestrata.llm import vocabulary
from codestrata.llm.encode import decode, encode, token_counts

TEXTS = [
    None, "", " ", "\n\n  x", "it's don't I'LL we've", "<|endoftext|> and <|startoftext|>", "a" * 5000, " " * 3000 + "x", "日本語のテキスト。", "naïve café Ünïcode ß", "🙂👩‍👩‍👧 emoji",
    "\x00\x01\x7f\u200b\u2028\u00a0tabs\tand\r\nlines\r", "x=1;\ty=2.50e3", "½ Ⅷ ٣ ４", "word " * 2000, "\u0378 unassigned \U0001e900", "ﬁ ǅ ʰ", "__init__ $var->call()",
]
SCHEMA = "doc_id long, text string, ids string, pos int, word string"


def reference(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary.default_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library_s_and_decode_to_the_text(spark):
    rows = [(i, t, "clash", 0, "clash") for i, t in enumerate(TEXTS)]
    encoded = encode(spark.createDataFrame(rows, SCHEMA)).cache()
    got = {r.doc_id: r.ids for r in encoded.collect()}
    assert encoded.count() == len(TEXTS) and got == {i: reference(t) for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.text for r in decode(encoded).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}


def test_repeated_and_null_ids_are_rows_of_their_own(spark):
    rows = [(1, "ab cd"), (1, "ab cd"), (1, "other text entirely"), (None, "null id"), (None, None), (2, "")]
    got = encode(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.ids) for r in got), key=key) == sorted(((i, reference(t)) for i, t in rows), key=key)


def test_rare_words_reuse_the_shuffle_of_the_texts(spark, tmp_path, monkeypatch):
    import codestrata.llm.encode as module

    monkeypatch.setattr(module, "HEAD_WORDS", 3)
    spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    out = encode(spark.read.parquet(str(tmp_path / "d")))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("MapInArrow") == 1 and "ReusedExchange" in plan


def test_random_code_points(spark):
    rng = random.Random(4)
    pick = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0xD7FF), rng.randrange(0xE000, 0xFFFE), rng.randrange(0x10000, 0x1FFFF)]))
    texts = ["".join(pick() for _ in range(120)) for _ in range(120)]
    got = {r.doc_id: r.ids for r in encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [i for i, t in enumerate(texts) if got[i] != reference(t)] == []


def test_words_beyond_the_broadcast_head(spark, monkeypatch):
    import codestrata.llm.encode as module

    monkeypatch.setattr(module, "HEAD_WORDS", 3)
    monkeypatch.setattr(module, "LONG_WORDS", 1)
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    got = {r.doc_id: r.ids for r in encode(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: reference(t) for i, t in rows}


def test_empty_table_and_counts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    assert encode(df.limit(0)).count() == 0 and decode(encode(df.limit(0))).count() == 0
    assert {r.doc_id: r.tokens for r in token_counts(df).collect()} == {i: len(reference(t)) for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("text", [" " * 1_200_000, "\n" * 1_200_000, "ab " * 400_000])
def test_very_long_texts(text):
    ids = vocabulary.encode(text, vocabulary.default_path())
    names = {v: k for k, v in vocabulary.ranks(vocabulary.default_path()).items()}
    assert b"".join(names[i] for i in ids).decode() == text


def test_lists_cut_inside_a_character_decode(spark):
    ids = vocabulary.encode("ab 漢", vocabulary.default_path())
    df = spark.createDataFrame([(1, ids[:-1]), (2, None), (3, []), (4, [10**6])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in decode(df).collect()}
    assert got[1].startswith("ab ") and "\ufffd" in got[1] and (got[2], got[3], got[4]) == ("", "", "")


def _every_code_point():
    """Texts in which each code point stands beside letters, digits, white space and itself."""
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    return ["".join(f"a{chr(c)}b1{chr(c)} {chr(c)}{chr(c)}.\n" for c in points[i : i + 4000]) for i in range(0, len(points), 4000)]


def test_both_splitters_agree_on_every_code_point():
    path = vocabulary.default_path()
    whole = vocabulary.encoding(path)
    for text in _every_code_point():
        assert whole.encode_ordinary(text) == [i for w in vocabulary.split_words(text) for i in vocabulary.encode_word(w, path)]


def test_spark_splits_every_code_point_alike(spark):
    from codestrata.llm.encode import split_texts

    texts = _every_code_point()
    rows = [(i, t) for i, t in enumerate(texts)]
    for r in split_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), "doc_id", "text").toLocalIterator():
        assert list(r.words) == vocabulary.split_words(texts[r.id])
    # the texts above all have an unassigned code point or none; those without go through the JVM one by one
    import unicodedata

    known = [chr(c) for c in range(0x3000) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    joined = ["".join(f"a{c}b1{c} {c}{c}.\n" for c in known[i : i + 50]) for i in range(0, len(known), 50)]
    for r in split_texts(spark.createDataFrame(list(enumerate(joined)), "doc_id long, text string"), "doc_id", "text").toLocalIterator():
        assert list(r.words) == vocabulary.split_words(joined[r.id])

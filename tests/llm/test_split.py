import pytest

from codestrata.llm import vocabulary
from codestrata.llm.split import Splitter, cohesion_depths, split_oversized

PATH = vocabulary.default_path()
PROSE = "\n\n".join(" ".join(f"The {w} of the {w} is {w}{i}." for i in range(12)) for w in ("river", "engine", "garden", "market"))
TEXTS = [PROSE, "x " * 900, "a" * 4000, "漢字" * 700, "🙂" * 500, "\n" * 900, "z\n" * 800, "one line " * 500 + "\n\n" + "tail", "é" * 2500 + ". " + "b" * 900]


@pytest.mark.parametrize("limit,overlap", [(50, 5), (120, 40), (33, 0), (20, 15), (4, 1)])
def test_pieces(limit, overlap):
    s = Splitter(PATH)
    for text in TEXTS:
        got = s.pieces(text, limit, overlap)
        ids = vocabulary.encode(text, PATH)
        assert got[0][0] == 0 and got[-1][1] == len(text) and got[-1][3] == len(ids)
        for a, b, _, _, n, _ in got:
            assert n == len(vocabulary.encode(text[a:b], PATH)) <= limit
        for x, y in zip(got, got[1:]):
            assert x[0] < y[0] <= x[1] < y[1]  # no gap, and something new each time
            shared = x[3] - y[2]
            assert shared >= overlap - 1 or y[2] == 0 or limit < 40  # little room: a piece cut inside a word may share less
        if text is PROSE and limit > 30:
            assert all(p[5] in ("paragraph", "sentence", "line", "end") for p in got)


def test_valleys_lie_between_topics():
    units = ["cat dog cat", "dog cat", "cat dog", "tax law tax", "law tax", "tax law"]
    depths = cohesion_depths(units, 3)
    assert max(range(5), key=depths.__getitem__) == 2 and cohesion_depths(["one"]) == []


def test_cohesion_equals_brute_force():
    import random
    from collections import Counter
    from math import sqrt

    rng = random.Random(3)
    units = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(6))) for _ in range(60)]
    for k in (1, 3, 6):
        sims = []
        for g in range(59):
            a, b = (Counter(" ".join(u).split()) for u in (units[max(0, g + 1 - k) : g + 1], units[g + 1 : g + 1 + k]))
            norm = sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
            sims.append(sum(a[w] * b[w] for w in a) / norm if norm else 0.0)

        def peak(i, step):
            while 0 <= i + step < 59 and sims[i + step] >= sims[i]:
                i += step
            return sims[i]

        assert cohesion_depths(units, k) == pytest.approx([peak(i, -1) + peak(i, 1) - 2 * sims[i] for i in range(59)])


def test_an_overlap_must_be_below_its_limit(spark):
    docs = spark.createDataFrame([(1, PROSE, "prose")], "doc_id long, text string, doc_kind string")
    with pytest.raises(Exception, match="overlap of 60 tokens, limit of 60"):
        split_oversized(docs, spark.createDataFrame([("prose", 60, 60)], "doc_kind string, max_tokens int, overlap_tokens int")).collect()
    got = split_oversized(docs, spark.createDataFrame([("prose", 60, 40)], "doc_kind string, max_tokens int, overlap_tokens int")).orderBy("piece").collect()
    assert got[0].overlap == 0 and all(r.overlap == before.end_token - r.start_token and r.overlap >= 40 for before, r in zip(got, got[1:]))


def test_table(spark):
    rows = [(1, PROSE, "prose", "c"), (2, "short", "prose", "c"), (3, None, "prose", "c"), (4, PROSE, None, "c"), (5, PROSE, "unknown", "c"), (6, "", "prose", "c"), (1, PROSE, "prose", "c"), (7, PROSE, "none", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc_kind string, piece string")
    limits = spark.createDataFrame([("prose", 100, None), ("none", None, 5)], "doc_kind string, max_tokens int, overlap_tokens int")
    got = split_oversized(docs, limits).collect()
    assert {r.doc_id for r in got} == {1} and all(r.text == PROSE[r.start_char : r.end_char] for r in got)
    assert len(got) == 2 * len({r.piece for r in got}) and split_oversized(docs.limit(0), limits).count() == 0

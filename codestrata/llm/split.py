"""Splitting oversized texts at natural boundaries, by lexical cohesion."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate
from math import sqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm import vocabulary

#: Units (lines and sentences) on either side of a gap whose words are compared.
BLOCK_UNITS = 6
#: A cut is looked for in the last part of what fits, from this share of it on.
LEAST_FILL = 0.5
#: Limits of at most so many kinds are sent to every task; more are joined, and a crowded kind is split at run time.
MOST_KINDS = 10_000

_BREAK = re.compile(r"\n[ \t\r]*\n\s*|\n|(?<=[.!?;])\s+|(?<=[。！？])")
_WORD = re.compile(r"\w+")


def _breaks(text: str) -> list[tuple[int, str]]:
    """Natural breaks: (offset at which the next unit starts, paragraph, line or sentence), in order."""
    out = []
    for m in _BREAK.finditer(text):
        kind = "paragraph" if m.group().count("\n") > 1 else "line" if "\n" in m.group() else "sentence"
        if 0 < m.end() < len(text):
            out.append((m.end(), kind))
    return out


def cohesion_depths(units: list[str], k: int = BLOCK_UNITS) -> list[float]:
    """For the gap after each unit but the last: how deep the valley of word similarity is there.

    Similarity of a gap: cosine of the word counts of the `k` units before and after it. Depth: how far the similarity
    climbs on the way to the nearest peak on the left plus the same on the right.
    """
    numbers: dict[str, int] = {}
    words = [[numbers.setdefault(w.lower(), len(numbers)) for w in _WORD.findall(u)] for u in units]
    n = len(units)
    if n < 2:
        return []
    left, right = [0] * len(numbers), [0] * len(numbers)
    dot = left_norm = right_norm = 0  # kept up word by word, so a gap costs no more than the words that it passes
    for w in words[0]:
        left_norm += 2 * left[w] + 1
        left[w] += 1
    for unit in words[1 : 1 + k]:
        for w in unit:
            dot += left[w]
            right_norm += 2 * right[w] + 1
            right[w] += 1
    sims = []
    for gap in range(n - 1):
        norm = sqrt(left_norm * right_norm)
        sims.append(dot / norm if norm else 0.0)
        for w in words[gap + 1]:  # from the right block to the left one
            right[w] -= 1
            right_norm -= 2 * right[w] + 1
            dot += right[w] - left[w]
            left_norm += 2 * left[w] + 1
            left[w] += 1
        if gap + 1 - k >= 0:
            for w in words[gap + 1 - k]:
                left[w] -= 1
                left_norm -= 2 * left[w] + 1
                dot -= right[w]
        if gap + 1 + k < n:
            for w in words[gap + 1 + k]:
                dot += left[w]
                right_norm += 2 * right[w] + 1
                right[w] += 1
    peak_left, peak_right = list(sims), list(sims)
    for i in range(1, len(sims)):  # the peak to which one climbs without going down again
        if sims[i - 1] >= sims[i]:
            peak_left[i] = peak_left[i - 1]
    for i in range(len(sims) - 2, -1, -1):
        if sims[i + 1] >= sims[i]:
            peak_right[i] = peak_right[i + 1]
    return [pl + pr - 2 * s for pl, pr, s in zip(peak_left, peak_right, sims)]


class Splitter:
    """Cuts texts by one vocabulary; words' ids are remembered between texts."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.known: dict[str, list[int]] = {}
        self.bytes_of = {number: piece for piece, number in vocabulary.ranks(path).items()}

    def _inside(self, word: str, ids: list[int], at: int) -> tuple[int, int]:
        """(tokens, characters) of the longest prefix of at most `at` of a word's tokens that ends with a character."""
        while at:
            try:
                return at, len(b"".join(self.bytes_of[i] for i in ids[:at]).decode())
            except UnicodeDecodeError:
                at -= 1
        return 0, 0

    def pieces(self, text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int, int, str]]:
        """(start, end, first token, end token, tokens of the piece by itself, kind of the cut that ends it)."""
        words = vocabulary.words_with_ids(text, self.path, self.known)
        if len(self.known) > 500_000:
            self.known.clear()
        chars = list(accumulate((len(w) for w, _ in words), initial=0))
        tokens = list(accumulate((len(i) for _, i in words), initial=0))
        total = tokens[-1]
        overlap = max(0, overlap)
        breaks = _breaks(text)
        edges = [0, *(b for b, _ in breaks), len(text)]
        depths = cohesion_depths([text[a:b] for a, b in zip(edges, edges[1:])])
        strength = {"paragraph": 2, "line": 1, "sentence": 0}
        gaps = []  # natural breaks between words: (word index, depth, strength, kind)
        for (offset, kind), depth in zip(breaks, depths):
            i = bisect_left(chars, offset)
            if i < len(chars) and chars[i] != offset and text[chars[i - 1] : offset].isspace():
                i -= 1  # the break's white space belongs to the next word: cut before it
            if 0 < i < len(words) and (chars[i] == offset or text[chars[i] : offset].isspace()):
                gaps.append((i, round(depth, 9), strength[kind], kind))
        gap_tokens = [tokens[g[0]] for g in gaps]
        out: list[tuple[int, int, int, int, int, str]] = []
        start_char, start_token = 0, 0
        new_from = 0  # tokens up to here are in earlier pieces
        while True:
            room = limit
            if total - start_token <= room and (n := self._count(text[start_char:])) <= limit:
                out.append((start_char, len(text), start_token, total, n, "end"))
                return out
            while True:  # a piece that starts inside a word may need more tokens by itself: then take less
                end_token, end_char, kind = self._cut(words, chars, tokens, gaps, gap_tokens, start_token, max(new_from, min(start_token + overlap, start_token + room - 1)), room)
                n = self._count(text[start_char:end_char])
                if n <= limit or room <= 1:
                    break
                room -= n - limit
                if start_token + room <= new_from:  # the overlap leaves no room for anything new: start later
                    start_token, start_char, room = new_from, self._char_at(words, chars, tokens, new_from)[1], limit
            out.append((start_char, end_char, start_token, end_token, n, kind if end_char < len(text) else "end"))
            if end_char == len(text):
                return out
            new_from = end_token
            start_token, start_char = self._char_at(words, chars, tokens, end_token - overlap)
            if start_token <= out[-1][2]:
                start_token, start_char = end_token, end_char

    def _count(self, text: str) -> int:
        return len(vocabulary.encode(text, self.path))

    def _char_at(self, words, chars, tokens, token: int) -> tuple[int, int]:
        """The token at or before `token` that starts with a character, and that character's offset."""
        i = bisect_right(tokens, token) - 1
        if i >= len(words):
            return tokens[-1], chars[-1]
        k, c = self._inside(words[i][0], words[i][1], token - tokens[i])
        return tokens[i] + k, chars[i] + c

    def _cut(self, words, chars, tokens, gaps, gap_tokens, start: int, new_from: int, room: int):
        """Where a piece from token `start` ends, after token `new_from` and within `room` tokens: (token, offset, kind)."""
        latest = start + room
        low = max(new_from + 1, start + int(room * LEAST_FILL))
        a, b = bisect_left(gap_tokens, low), bisect_right(gap_tokens, latest)
        if a < b:  # the deepest valley in the window; then the stronger break, then the later
            best = max(gaps[a:b], key=lambda g: (g[1], g[2], g[0]))
            return tokens[best[0]], chars[best[0]], best[3]
        a = bisect_left(gap_tokens, new_from + 1)
        if a < b:
            best = gaps[b - 1]
            return tokens[best[0]], chars[best[0]], best[3]
        last = bisect_right(tokens, latest) - 1
        for i in range(last, 0, -1):
            if tokens[i] <= new_from:
                break
            if i < len(words) and words[i][0][:1].isspace():
                return tokens[i], chars[i], "word"
        if last > 0 and tokens[last] > new_from:
            return tokens[last], chars[last], "word part"
        i = bisect_right(tokens, new_from) - 1  # one word fills the whole room: cut it between characters
        k, c = self._inside(words[i][0], words[i][1], latest - tokens[i])
        if tokens[i] + k <= new_from:  # a single character of more tokens than there is room for stays whole
            k = latest - tokens[i]
            while k < len(words[i][1]) and self._inside(words[i][0], words[i][1], k)[0] + tokens[i] <= new_from:
                k += 1
            k, c = self._inside(words[i][0], words[i][1], k)
        return tokens[i] + k, chars[i] + c, "character"


def split_oversized(
    docs: DataFrame, limits: DataFrame, kind_column: str = "doc_kind", id_column: str = "doc_id", text_column: str = "text", path: str | None = None, with_text: bool = True
) -> DataFrame:
    """The pieces of each text with more tokens than `max_tokens` of its kind; other texts give no rows.

    `limits`: the kind column, `max_tokens`, `overlap_tokens`; a small table. Returned: the id, `piece` from 0,
    `start_char`, `end_char`, `start_token`, `end_token` (in the ids of the whole text), `n_tokens` (of the piece's own
    text, never above the limit unless the limit is below one character's tokens), `cut` (what ends the piece:
    paragraph, line, sentence, word, word part, character, or end), `max_tokens` and, if asked for, `text`. Pieces
    cover the text; each starts `overlap_tokens` before the one before it ends, or at the character boundary before
    that; `overlap` is what it really shares (less only where a character or a piece cut inside a word leaves no room for
    anything new). An overlap that isn't below its limit is an error. Null texts, null kinds and kinds without a limit give
    no rows, nor do null limits; a null overlap counts as 0, and so does a negative one. Rows that are repeated are split
    repeatedly. Other columns are not read.

    Method: words of sliding blocks before and after each line or sentence are compared; valleys of the similarity are
    topic boundaries; each piece ends at the deepest valley in the second half of what fits. Where there is no natural
    break, words and then characters are cut. Each text is worked on where it lies; nothing is shuffled.
    """
    path = path or vocabulary.default_path()
    bounds = limits.select(F.col(kind_column).alias("kind"), F.col("max_tokens").cast("int").alias("max_tokens"), F.coalesce("overlap_tokens", F.lit(0)).cast("int").alias("overlap")).where("max_tokens > 0")
    wrong = F.format_string("overlap of %d tokens, limit of %d", "overlap", "max_tokens")
    bounds = bounds.withColumn("overlap", F.when(F.col("overlap") < F.col("max_tokens"), F.col("overlap")).otherwise(F.raise_error(wrong)))
    if limits.limit(MOST_KINDS + 1).count() <= MOST_KINDS:
        bounds = F.broadcast(bounds)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(kind_column).alias("kind"))
    # a token has at least one byte, so texts of at most max_tokens bytes need not be encoded
    large = rows.join(bounds, "kind").where(F.octet_length("text") > F.col("max_tokens")).select("id", "text", "max_tokens", "overlap")
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, piece int, start_char int, end_char int, start_token int, end_token int, n_tokens int, overlap int, cut string, max_tokens int" + ", text string" * with_text

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        splitter = Splitter(path)
        names = [part.split()[0] for part in schema.split(", ")]
        for batch in batches:
            out = []
            for id_, text, limit, overlap in batch.itertuples(index=False):
                if len(vocabulary.encode(text, path)) > limit:
                    before = 0
                    for at, (a, b, s, e, n, cut) in enumerate(splitter.pieces(text, limit, overlap)):
                        out.append((id_, at, a, b, s, e, n, before - s, cut, limit, *([text[a:b]] if with_text else [])))
                        before = e
            yield pd.DataFrame(out, columns=names)

    return large.mapInPandas(split, schema).withColumnRenamed("id", id_column)

"""Public byte-level BPE vocabularies, read where they lie; the path is a parameter everywhere."""

from __future__ import annotations

import base64
from functools import lru_cache

#: Splits a text before merges; fixed by the vocabulary (the GPT-2 pattern, as its README states it).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(number) for piece, number in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def encoding(path: str):
    """The encoder of a rank file, one per Python worker. Special tokens' strings are ordinary text to it."""
    import tiktoken

    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


#: The library's splitter recurses over long runs of white space; longer texts are split outside it. Same ids.
_LONG = 100_000


def encode(text: str, path: str) -> list[int]:
    """The ids of a whole text, of any length."""
    if len(text) < _LONG:
        return encoding(path).encode_ordinary(text)
    known: dict[str, list[int]] = {}
    ids: list[int] = []
    for word in split_words(text):
        if word not in known:
            known[word] = encode_word(word, path)
        ids += known[word]
    return ids


def encode_word(word: str, path: str) -> list[int]:
    """The ids of one piece of the split."""
    return encoding(path)._encode_single_piece(word)


@lru_cache(maxsize=1)
def _splitter():
    import regex

    return regex.compile(PATTERN)


def split_words(text: str) -> list[str]:
    return _splitter().findall(text)


def words_with_ids(text: str, path: str, known: dict[str, list[int]]) -> list[tuple[str, list[int]]]:
    """The pieces of the split with their ids; `known` remembers words between calls."""
    out = []
    for word in split_words(text):
        ids = known.get(word)
        if ids is None:
            ids = known[word] = encode_word(word, path)
        out.append((word, ids))
    return out

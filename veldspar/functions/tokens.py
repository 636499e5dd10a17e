"""Token counts of byte-level BPE vocabularies: pairs of bytes are merged by rank, and a word's tokens are found once a task.

A vocabulary is a file of lines `base64 rank`. A text is cut into words by the vocabulary's pattern, each word is merged by itself, and what
is found is kept in a cache of CACHED words, which all texts of a task share; texts repeat their words, so merging is rare. Null texts have no
tokens. Special tokens are not looked for.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the pattern that byte-level BPE of this kind cuts texts by before it merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words that a task keeps the tokens of.
CACHED = 1 << 18


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The tokens of a word: of all neighbours the pair of the lowest rank is joined, the first of equal ones, until none is known."""
    if word in ranks:
        return [ranks[word]]
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        known = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not known:
            break
        _, at = min(known)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Counter:
    """Counts tokens of texts, with the cache of a task."""

    def __init__(self, path: str, pattern: str = PATTERN):
        import regex

        self.ranks, self.words = ranks_of(path), regex.compile(pattern).findall
        self.size = lru_cache(CACHED)(lambda word: len(merged(word.encode("utf-8", "surrogatepass"), self.ranks)))

    def __call__(self, text: str | None) -> int:
        return sum(map(self.size, self.words(text))) if text else 0

    def cut(self, text: str, most: int) -> str:
        """The longest beginning of whole words that has at most `most` tokens."""
        used, end = 0, 0
        for word in self.words(text):
            used += self.size(word)
            if used > most:
                return text[:end]
            end += len(word)
        return text


def token_count(text: Column, path: str) -> Column:
    """The number of tokens of a text, by a vocabulary that every machine finds at the path."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(path)
        for texts in batches:
            yield texts.map(counter).astype("int64")

    return count(text)


def cut_to_tokens(text: Column, most: int, path: str) -> Column:
    """The longest beginning of whole words of at most `most` tokens; null stays null."""

    @F.pandas_udf("string")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(path)
        for texts in batches:
            yield texts.map(lambda t: None if t is None else counter.cut(t, most))

    return cut(text)

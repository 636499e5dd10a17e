"""Token counts by a linear longest-match automaton.

A vocabulary of pieces, where a piece that begins a word starts with U+2581, is compiled into a trie with
failure links. Each state also holds how many pieces are popped when its failure link is followed, so one
pass over a word's characters adds up how many pieces greedy longest-prefix matching would give, without
building any. A character that no piece covers alone counts as its UTF-8 bytes (byte fallback).

Defined results: null and empty texts have 0 words and 0 tokens. Words are runs without U+0020 and U+0009
to U+000D, each counted with U+2581 before it. Whole texts are read. Repeated rows are counted one by one;
extra columns are kept, and columns of docs named like a result are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from veldspar.llm._shared import carried

BEGIN = "▁"
_SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
#: Words whose counts a worker remembers; more are counted again when they return.
REMEMBERED = 200_000


class LongestMatch:
    """States by number: children, failure link and popped count of each."""

    def __init__(self, pieces: Iterable[str]):
        self.children: list[dict[str, int]] = [{}]
        self.fail: list[int] = [-1]
        self.pops: list[int] = [0]
        ends = [False]
        for piece in pieces:
            at = 0
            for c in piece:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.fail.append(0)
                    self.pops.append(0)
                    ends.append(False)
                at = self.children[at][c]
            ends[at] = at > 0
        level = [(0, c, v) for c, v in self.children[0].items()]
        while level:
            following = []
            for parent, c, v in level:
                if ends[v]:
                    self.pops[v], self.fail[v] = 1, 0
                elif parent == 0:  # one character that is no piece: its bytes
                    self.pops[v], self.fail[v] = len(c.encode("utf-8", "surrogatepass")), 0
                else:
                    pops, z = self.pops[parent], self.fail[parent]
                    while c not in self.children[z] and z:
                        pops, z = pops + self.pops[z], self.fail[z]
                    if c in self.children[z]:
                        self.pops[v], self.fail[v] = pops, self.children[z][c]
                    else:  # the character is in no trie edge from the root: it stands alone
                        self.pops[v], self.fail[v] = pops + len(c.encode("utf-8", "surrogatepass")), 0
                following += [(v, x, w) for x, w in self.children[v].items()]
            level = following

    def count(self, word: str) -> int:
        """Pieces and fallback bytes of greedy longest-prefix matching."""
        children, fail, pops, at, n = self.children, self.fail, self.pops, 0, 0
        for c in word:
            while c not in children[at] and at:
                n += pops[at]
                at = fail[at]
            if c in children[at]:
                at = children[at][c]
            else:
                n += len(c.encode("utf-8", "surrogatepass"))
        while at:
            n += pops[at]
            at = fail[at]
        return n


def vocabulary(model_path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model file."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [p.id_to_piece(i) for i in range(p.vocab_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class _Memory(dict):
    def __init__(self, automaton: LongestMatch):
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self.automaton.count(BEGIN + word)
        if len(word) <= 64:
            self[word] = n
        return n


def count_tokens(docs: DataFrame, text_col: str = "text", model_path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs with n_words and n_tokens."""
    new = ["n_words", "n_tokens"]
    kept = carried(docs, keep, new)
    source = docs.select(*kept, docs[text_col].alias("__text"))
    schema = T.StructType([*docs.select(*kept).schema.fields, *(T.StructField(n, T.LongType()) for n in new)])
    path = model_path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Memory(LongestMatch(vocabulary(path)))
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(len(kept)):
                found = _SPLIT.findall(text.as_py() or "")
                words.append(len(found))
                tokens.append(sum(map(known.__getitem__, found)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=[*kept, *new])

    return source.mapInArrow(run, schema)

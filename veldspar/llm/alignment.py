"""Alignment of the tokens that two tokenizers make of the same texts.

A is a byte-level BPE (a tokenizers JSON file), which is given a space and the text; B is a sentencepiece model, which adds the
space itself. Both cut the same bytes, so A's and B's tokens are the two sides of a graph whose links are
the pairs of tokens that have bytes in common. Links are found from byte positions: a token is linked to that of the other
side which holds its first byte, and that is all links, as of two overlapping tokens the later one begins within the other.
Union-find over the links joins tokens until nothing changes (every root hangs itself on the least root that a link of its leads to,
then paths are halved, in numpy for all texts of a block at once). The components are the minimal groups: where an A token and
a B token end at the same byte no link goes across, everywhere else one does.

Pair counts over the corpus: texts are taken in blocks of BATCH characters at most. A block counts its links by id pair and stores,
for each text, which of the block's pairs it has and how often. Spark adds up the pairs of all blocks, finds each B id's highest
count, sends every block the counts of its own pairs, and the block adds them up by text. So a pair that stands in
every text is a row for each block, not for each link, and no text's links are ever moved one by one.

A's ids are found with tiktoken, whose merges are those of the JSON file: it has the pairs in order of their ids
(checked), and gives the same ids as tokenizers in a quarter of the time. Special tokens are never looked for: their strings in texts are text.

Defined results: texts that are null or empty, or that one of the tokenizers doesn't give back byte by byte, have no tokens: zeros
and an empty digest. Repeated rows are counted each. An empty table gives an empty result. Extra columns are kept, and columns of
docs named like a result are replaced. Memory grows with the longest text (some 60 bytes for each of its bytes).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldspar.llm._shared import carried, materialise

#: Characters of text in a block; a longer text is one by itself.
BATCH = 4 << 20
# Fixed value: the pattern that byte-level BPE of this kind cuts texts by before it merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the others in order from
    U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Byte-level BPE of a tokenizers JSON file, without its special tokens."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        vocab, merges = given["model"]["vocab"], given["model"]["merges"]
        made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in merges]
        if given.get("normalizer") or any(a >= b for a, b in zip(made, made[1:], strict=False)):
            raise ValueError("only vocabularies without a normaliser and with ids in order of merges are supported")
        alphabet, special = byte_alphabet(), {t["content"] for t in given.get("added_tokens", []) if t.get("special")}
        ranks = {bytes(map(alphabet.__getitem__, t)): i for t, i in vocab.items() if t not in special}
        self.size = max(vocab.values()) + 1
        self.lengths = np.zeros(self.size, np.int32)
        for token, i in ranks.items():
            self.lengths[i] = len(token)
        self.inner = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        return self.inner.encode_to_numpy(text, disallowed_special=()).astype(np.int32)


class Pieces:
    """A sentencepiece model and the bytes of its pieces."""

    def __init__(self, path: str):
        import sentencepiece

        self.inner = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.inner.vocab_size()
        piece = self.inner.id_to_piece
        self.bytes = [bytes([int(piece(i)[3:-1], 16)]) if self.inner.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.size)]
        self.lengths = np.array([len(x) for x in self.bytes], np.int32)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.inner.encode(texts, num_threads=1)


def components(n: int, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Union-find: the least node of each node's component, by links between nodes."""
    parent = np.arange(n, dtype=np.int32)
    while len(one):
        a, b = parent[one], parent[other]
        apart = a != b
        one, other, a, b = one[apart], other[apart], a[apart], b[apart]
        parent[np.maximum(a, b)] = np.minimum(a, b)
        while True:
            above = parent[parent]
            if np.array_equal(above, parent):
                break
            parent = above
    return parent


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids as decimal digits from the left, with room for a sign after them, and their number."""
    width = len(str(max(1, n - 1)))
    written = np.frombuffer(b"".join(str(i).encode().ljust(width + 1) for i in range(n)), np.uint8).reshape(n, width + 1)
    return written, np.fromiter((len(str(i)) for i in range(n)), np.int64, n)


class Aligner:
    """Groups, links and pair counts of a block of texts."""

    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = ByteBpe(byte_path), Pieces(piece_path)
        self.written, self.long = _digits(max(self.a.size, self.b.size))

    def tokens(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """A's and B's ids of each text; none for texts that are not given back as they are."""
        none = np.zeros(0, np.int32)
        left, right = [], []
        for text, ids in zip(texts, self.b.encode([t or "" for t in texts]), strict=True):
            whole = b" " + (text or "").encode()
            if not text or b"".join(map(self.b.bytes.__getitem__, ids)) != whole:
                left.append(none)
                right.append(none)
                continue
            found = self.a.encode(" " + text)
            fits = int(self.a.lengths[found].sum()) == len(whole)
            left.append(found if fits else none)
            right.append(np.array(ids, np.int32) if fits else none)
        return left, right

    def block(self, texts: list[str | None]) -> dict:
        left, right = self.tokens(texts)
        n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in (left, right))
        a, b = (np.concatenate(side) if side else np.zeros(0, np.int32) for side in (left, right))
        ends_a, ends_b = np.cumsum(self.a.lengths[a], dtype=np.int64), np.cumsum(self.b.lengths[b], dtype=np.int64)
        starts_a, starts_b = ends_a - self.a.lengths[a], ends_b - self.b.lengths[b]
        size = int(ends_a[-1]) + 1 if len(a) else 1

        def before(ends: np.ndarray) -> np.ndarray:
            """For each byte position the number of tokens that end up to there."""
            marks = np.zeros(size, np.int8)
            marks[ends] = 1
            return np.cumsum(marks, dtype=np.int32)

        begun = np.zeros(size, bool)
        begun[starts_a] = True
        later = np.flatnonzero(~begun[starts_b]).astype(np.int32)
        link_a = np.concatenate((np.arange(len(a), dtype=np.int32), before(ends_a)[starts_b[later]]))
        link_b = np.concatenate((before(ends_b)[starts_a], later))
        root = components(len(a) + len(b), link_a, link_b + np.int32(len(a)))
        first = root[: len(a)] == np.arange(len(a))
        number = np.cumsum(first) - 1
        groups = np.concatenate(([0], number + 1))
        bounds = np.concatenate(([0], np.cumsum(n_a)))
        docs = np.repeat(np.arange(len(texts)), n_a)[link_a]
        codes, pairs = pd.factorize(a[link_a].astype(np.int64) * self.b.size + b[link_b])
        held, times = np.unique(docs * max(1, len(pairs)) + codes, return_counts=True)
        of_doc = np.searchsorted(held // max(1, len(pairs)), np.arange(len(texts) + 1))
        return {
            "n_a": n_a, "n_b": n_b, "n_groups": groups[bounds[1:]] - groups[bounds[:-1]], "n_links": np.bincount(docs, minlength=len(texts)),
            "groups_sha256": self._digests(a, b, number[root[: len(a)]], number[root[len(a) :]], n_a, n_b),
            "places": (held % max(1, len(pairs))).astype(np.int32), "times": times.astype(np.int32), "of_doc": of_doc.astype(np.int32),
            "pairs": pairs, "n": np.bincount(codes, minlength=len(pairs)),
        }

    def _digests(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> list[str]:
        """The digest of each text's groups: ids and signs are laid out for all texts at once."""
        if not len(a):
            return [""] * len(n_a)
        in_a, in_b = np.bincount(group_a), np.bincount(group_b)
        at_a = np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]
        at_b = np.arange(len(b)) + np.cumsum(in_a)[group_b]
        ids, signs = np.empty(len(a) + len(b), np.int32), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[at_a], ids[at_b] = a, b
        signs[at_a[np.cumsum(in_a) - 1]], signs[at_b[np.cumsum(in_b) - 1]] = ord("|"), ord(";")
        long = self.long[ids]
        laid = self.written[ids]
        laid[np.arange(len(ids)), long] = signs
        text = laid[np.arange(laid.shape[1]) <= long[:, None]].tobytes()
        ends = np.concatenate(([0], np.cumsum(long + 1)))[np.concatenate(([0], np.cumsum(n_a + n_b)))].tolist()
        return [hashlib.sha256(text[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(ends, ends[1:], strict=False)]


#: Columns of the result, but for the two that need the whole corpus.
_OWN = {"n_a": T.LongType(), "n_b": T.LongType(), "n_groups": T.LongType(), "n_links": T.LongType(), "groups_sha256": T.StringType()}
_ALL = [*_OWN, "n_best", "count_sum"]


def blocks(docs: DataFrame, byte_path: str, piece_path: str, text_col: str, kept: list[str], batch: int = BATCH) -> DataFrame:
    """A row for each text (its counts, and places and times of its pairs) and one for each block (pairs and n)."""
    source = docs.select(*kept, docs[text_col].alias("__text"))
    ints = T.ArrayType(T.IntegerType())
    own = {"block": T.LongType(), **_OWN, "places": ints, "times": ints, "pairs": T.ArrayType(T.LongType()), "n": T.ArrayType(T.LongType())}
    fields = [T.StructField(f.name, f.dataType) for f in source.select(*kept).schema.fields]
    schema = T.StructType([*fields, *(T.StructField(f"__{n}", t) for n, t in own.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = Aligner(byte_path, piece_path), TaskContext.get().partitionId() << 32
        for given in batches:
            texts, at = given.column(len(kept)).to_pylist(), 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end] or "") <= batch):
                    size += len(texts[end] or "")
                    end += 1
                x, part = aligner.block(texts[at:end]), given.slice(at, end - at)
                lists = lambda c, x=x: pa.ListArray.from_arrays(pa.array(x["of_doc"]), pa.array(x[c]))
                one = lambda c, x=x: pa.ListArray.from_arrays(pa.array([0, len(x[c])], pa.int32()), pa.array(x[c], pa.int64()))
                rows, long = end - at, pa.list_(pa.int64())
                values = [pa.array([number] * rows), *(pa.array(x[c]) for c in _OWN), lists("places"), lists("times"), pa.nulls(rows, long), pa.nulls(rows, long)]
                names = [*kept, *(f"__{n}" for n in own)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *values], names=names)
                empty = [pa.nulls(1, c.type) for c in [*part.columns[:-1], *values[1:-2]]]
                yield pa.RecordBatch.from_arrays([*empty[: len(kept)], pa.array([number]), *empty[len(kept) :], one("pairs"), one("n")], names=names)
                number, at = number + 1, end

    return source.mapInArrow(run, schema)


def align(docs: DataFrame, byte_path: str, piece_path: str, text_col: str = "text", keep: list[str] | None = None, batch: int = BATCH) -> DataFrame:
    """docs with n_a, n_b (tokens), n_groups, n_links, groups_sha256, n_best (links whose count in the corpus is the highest of their B
    id) and count_sum (the counts of all links)."""
    kept = carried(docs, keep, _ALL)
    held = materialise(blocks(docs, byte_path, piece_path, text_col, kept, batch), "alignment-blocks")
    met, counts = pair_counts(held, Pieces(piece_path).size)
    answers = met.join(counts, "pair").select("block", "place", "total", "best")
    rows = held.where("__pairs is null").drop("__pairs", "__n")
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in rows.select(*kept).schema.fields), *(T.StructField(n, _OWN.get(n, T.LongType())) for n in _ALL)])

    def told(texts: pa.Table, found: pa.Table) -> pa.Table:
        place = found["place"].to_numpy()
        total, best = np.zeros(place.max(initial=-1) + 1, np.int64), np.zeros(place.max(initial=-1) + 1, np.int64)
        total[place], best[place] = found["total"].to_numpy(), found["best"].to_numpy()
        out = []
        for part in texts.combine_chunks().to_batches():
            places, times = part["__places"].flatten().to_numpy(), part["__times"].flatten().to_numpy().astype(np.int64)
            ends = np.concatenate(([0], np.cumsum(part["__places"].value_lengths().to_numpy())))
            summed = [(s := np.concatenate(([0], np.cumsum(times * of[places]))))[ends[1:]] - s[ends[:-1]] for of in (best, total)]
            out.append(pa.record_batch([*(part[c] for c in kept), *(part[f"__{c}"] for c in _OWN), *map(pa.array, summed)], names=[*kept, *_ALL]))
        return pa.Table.from_batches(out)

    return rows.groupBy("__block").cogroup(answers.groupBy("block")).applyInArrow(told, schema)


def pair_counts(held: DataFrame, b_size: int) -> tuple[DataFrame, DataFrame]:
    """Of blocks: their pairs (block, place, pair, n), and over all blocks each pair's total and whether it is best, its B id's
    highest (1, else 0)."""
    zipped = F.arrays_zip(F.col("__pairs").alias("pair"), F.col("__n").alias("n"))
    met = held.where("__pairs is not null").select(F.col("__block").alias("block"), F.posexplode(zipped).alias("place", "x")).select("block", "place", "x.pair", "x.n")
    counts = materialise(met.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("b", F.col("pair") % b_size), "alignment-pairs")
    highest = counts.groupBy("b").agg(F.max("total").alias("highest"))
    return met, counts.join(highest, "b").select("pair", "total", (F.col("total") == F.col("highest")).cast("int").alias("best"))

"""A Katz backoff language model, learned, stored in partitioned tables, and evaluated recursively per token.

Model. n-gram counts up to DISCOUNTED are discounted by Good-Turing's estimate, for each length by itself. After a
context v, a word w that was seen there has probability d * c(v w) / c(v); any other backs off to weight(v) times
its probability after v without its first word. weight(v) is what the words seen after v leave over, divided by what
their probabilities one order lower leave over, so the probabilities after every v add up to one exactly. The
recursion ends at P(w) = d * c(w) / N, and the mass that unigram discounts free belongs to one unknown word. Where
nothing is left over, one is added to the denominator. The order is a parameter.

Tables. `word` gives each word's 64-bit hash, count and number; frequent words have small numbers. `gram2`, `gram3`, ...
give (number of the gram without its last word, number of the last word) with the count; `context2`, ... give the
denominator and backoff weight of each context by its number. Each is partitioned by a hash of its key and holds
one row of packed arrays a partition. They answer for documents that were not there when they were made (`score_with`),
can be saved and loaded, and the number of partitions follows the number of entries. n-grams that only documents to
be scored have are held with a count of 0.

Execution. Documents are packed into blocks of about BLOCK tokens. A block sends each partition one row with its
distinct entries, counts already added up, and gets one row back. So no word, however frequent, has more than
one entry a block, nothing is broadcast, and all sizes follow the input. A seen n-gram is owned by one block, which adds
it to the sums of its context; a weight is sent back only where a block backs off.

Words are told apart by their 64-bit hash. Defined results: a null text is empty; a text ends in one end
token, which counts. With no training documents every word is unknown. Null ids are kept, and belong to the
training side unless the caller says otherwise. Repeated rows are learned from and scored one by one. Extra
columns are ignored. An empty table gives none.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.llm._shared import materialise, materialise_bucketed

ORDER = 2
#: Counts up to this are discounted.
DISCOUNTED = 5
#: Tokens of a block.
BLOCK = 2_500_000
#: Bytes of text whose blocks share a bucket, about; buckets, at most.
BUCKET, MOST_BUCKETS = 16 << 20, 50_000
#: Distinct entries that one partition of a table receives, about.
PART = 1_000_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: White space cannot be in a word, so it can name the end of a text and the start before it.
_END, _START = b"\n", b" "
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: The number of what a table does not hold.
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def pack(a: np.ndarray) -> bytes:
    """Compressed bytes of an array, plane by plane."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()) if len(a) else b""


def unpack(data: bytes, kind: type) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(size, -1).T).view(kind).ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=a.dtype.type(0)))


def unpack_sorted(data: bytes, kind: type) -> np.ndarray:
    return np.cumsum(unpack(data, kind), dtype=kind)


def pack_pairs(first: np.ndarray, second: np.ndarray) -> tuple[bytes, bytes]:
    """Pairs in order of first and second: steps of first, and of second where first stays."""
    step = second.copy()
    stays = np.flatnonzero(first[1:] == first[:-1]) + 1
    step[stays] -= second[stays - 1]
    return pack_sorted(first), pack(step)


def unpack_pairs(a: bytes, b: bytes) -> tuple[np.ndarray, np.ndarray]:
    moved, step = unpack(a, np.uint64), unpack(b, np.uint64)
    if not len(step):
        return step, step
    begins = np.flatnonzero(moved)
    begins = begins if len(begins) and begins[0] == 0 else np.concatenate(([0], begins))
    total = np.cumsum(step, dtype=np.uint64)
    return np.cumsum(moved, dtype=np.uint64), total - np.repeat(total[begins] - step[begins], np.diff(begins, append=len(step)))


def word_hash(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def mixed(first: np.ndarray, second: np.ndarray | int = 0) -> np.ndarray:
    """A 64-bit hash of two numbers, in order."""
    x = (first * _MIX) ^ (first >> np.uint64(29))
    x = (x + np.asarray(second, np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def discounts(of_count: list[int], k: int = DISCOUNTED) -> np.ndarray:
    """Good-Turing factors d[0..k] from the numbers of n-grams of count 1..k+1; 1 where the estimate is
    undefined or not within (0, 1]."""
    d, n = np.ones(k + 1), [0, *of_count]
    if n[1] and (rest := (k + 1) * n[k + 1] / n[1]) < 1:
        for r in range(1, k + 1):
            if n[r]:
                x = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest)
                d[r] = x if 0 < x <= 1 else 1.0
    return d


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts * np.where(counts < len(d), d[np.minimum(counts, len(d) - 1)], 1.0)


class Unigrams:
    """Discounted unigram probabilities of counts."""

    def __init__(self, stats: list[int]):
        self.total, self.distinct = stats[-1], stats[-2]
        self.d = discounts(stats[: DISCOUNTED + 1])
        freed = sum((1 - self.d[r]) * r * stats[r - 1] for r in range(1, DISCOUNTED + 1))
        self.over = self.total if freed > 1e-9 else self.total + 1
        self.unknown = (freed if freed > 1e-9 else 1) / self.over

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, discounted(counts, self.d) / self.over, self.unknown)


_BLOCKS = "block long, n_words long, n_tokens long, words binary, tokens binary, keys binary, train binary, sizes binary"
_ASK = "part int, block long, a binary, b binary, c binary, d binary"
_ANSWER = "kind string, block long, part int, a binary, b binary, c binary, stats array<long>"
_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}


def _table(rows: list[dict], kinds: str) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=pa.schema([(n, _TYPES[t]) for n, t in (c.split() for c in kinds.split(", "))]))


def blocks(docs: DataFrame, tokens: int = BLOCK) -> DataFrame:
    """docs(key long, text string, train boolean) packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        numbers: defaultdict[bytes, int] = defaultdict()
        held: list[tuple[int | None, bool, np.ndarray]] = []
        n = 0

        def flush() -> pa.RecordBatch:
            nonlocal made, n
            h = word_hash(list(numbers))
            order = np.argsort(h)
            rank = np.empty(len(h), np.uint32)
            rank[order] = np.arange(len(h), dtype=np.uint32)
            row = {
                "block": task << 24 | made, "n_words": len(h), "n_tokens": n, "words": pack_sorted(h[order]), "tokens": pack(rank[np.concatenate([x for _, _, x in held])]),
                "keys": pack(np.array([-1 if k is None else k for k, _, _ in held], np.int64)), "train": pack(np.array([2 * (k is None) + t for k, t, _ in held], np.uint8)), "sizes": pack(np.array([len(x) for _, _, x in held], np.int64)),
            }
            made, n = made + 1, 0
            numbers.clear()
            held.clear()
            return _table([row], _BLOCKS).to_batches()[0]

        for batch in batches:
            for key, text, train in zip(*(batch[c] for c in ("key", "text", "train")), strict=True):
                numbers.default_factory = numbers.__len__
                numbers[_START]
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
                words.append(_END)
                held.append((key.as_py(), bool(train.as_py()), np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words))))
                n += len(words)
                if n >= tokens:
                    yield flush()
        if held:
            yield flush()

    return docs.select("key", "text", "train").mapInArrow(run, _BLOCKS)


@dataclass
class Level:
    """A block's distinct n-grams of one length. prefix and suffix are positions one level lower."""

    prefix: np.ndarray
    word: np.ndarray
    suffix: np.ndarray
    place: np.ndarray
    counts: np.ndarray


class Block:
    """A packed block and what the tables have answered to it."""

    def __init__(self, row: dict, order: int, upto: int, bits: dict[str, int], answers: list[dict], done: list[str]):
        """The levels up to one of a model of some order, with the answers of the tables named in done."""
        self.number, self.order, self.bits = row["block"], order, bits
        self.words = unpack_sorted(row["words"], np.uint64)
        tokens = unpack(row["tokens"], np.uint32).astype(np.int64)
        self.sizes, self.flags, self.keys = unpack(row["sizes"], np.int64), unpack(row["train"], np.uint8), unpack(row["keys"], np.int64)
        learned, n = np.repeat(self.flags % 2 == 1, self.sizes), len(self.words)
        begins = np.cumsum(self.sizes) - self.sizes
        start = int(np.searchsorted(self.words, word_hash([_START])[0]))
        place, special = tokens, start
        self.levels = [Level(np.zeros(n, np.int64), np.arange(n), np.zeros(n, np.int64), place, np.bincount(place[learned], minlength=n))]
        for k in range(2, upto + 1):
            before = np.empty_like(place)
            before[1:] = place[:-1]
            before[begins] = special
            key = before * n + tokens
            if k < order:  # what stands before a text is a context too
                key = np.append(key, special * n + start)
            entries, at = np.unique(key, return_inverse=True)
            suffix = np.empty(len(entries), np.int64)
            if k < order:
                suffix[at[-1]], special, at = special, int(at[-1]), at[:-1]
            suffix[at] = place
            self.levels.append(Level(entries // n, entries % n, suffix, at, np.bincount(at[learned], minlength=len(entries))))
            place = at
        self._take(answers, done)

    def _take(self, answers: list[dict], done: list[str]) -> None:
        """Numbers, counts and owned entries of each level, and what each level's contexts have."""
        by = defaultdict(list)
        for r in sorted(answers, key=lambda r: r["part"]):
            by[r["kind"]].append(r)
        read = lambda kind, field, dtype: np.concatenate([unpack(r[field], dtype) for r in by[kind]]) if by[kind] else np.zeros(0, dtype)
        self.ids, self.counts, self.own, self.over, self.weight = [read("word", "a", np.uint64)], [read("word", "b", np.int64)], [None], {}, {}
        for k, level in enumerate(self.levels[1:], 2):
            if f"gram{k}" not in done:
                break
            order, _ = self._grams(k)
            n = len(level.word)
            counts, own, ids = np.zeros(n, np.int64), np.zeros(n, bool), np.full(n, _NONE)
            counts[order], own[order] = read(f"gram{k}", "a", np.int64), read(f"gram{k}", "b", np.uint8) > 0
            if k < self.order:
                ids[order] = read(f"gram{k}", "c", np.uint64)
            self.counts.append(counts)
            self.own.append(own)
            self.ids.append(ids)
            if f"context{k}" in done:
                order, _ = self._contexts(k)
                over, weight = np.zeros(len(self.ids[k - 2])), np.ones(len(self.ids[k - 2]))
                over[order], weight[order] = read(f"context{k}", "a", np.int64), read(f"context{k}", "b", np.float64)
                self.over[k], self.weight[k] = over, weight

    def _grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Entries of a level that a table can hold, in order of part and key, and the bounds of the parts."""
        level = self.levels[k - 1]
        first, second = self.ids[k - 2][level.prefix], self.ids[0][level.word]
        held = np.flatnonzero((first != _NONE) & (second != _NONE))
        order = held[_pair_order(first[held], second[held])]
        return _by_part(order, mixed(first[order], second[order]), self.bits[f"gram{k}"])

    def _contexts(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """As _grams, of the entries one level lower that are contexts here."""
        used = np.unique(self.levels[k - 1].prefix)
        ids = self.ids[k - 2][used]
        order = used[np.argsort(ids)]
        order = order[self.ids[k - 2][order] != _NONE]
        return _by_part(order, mixed(self.ids[k - 2][order]), self.bits[f"context{k}"])

    def ask_words(self) -> list[dict]:
        cut = _cuts(self.words, self.bits["word"])
        return self._asks(cut, lambda s: {"a": pack_sorted(self.words[s]), "b": pack(self.levels[0].counts[s])})

    def ask_grams(self, k: int) -> list[dict]:
        level = self.levels[k - 1]
        order, cut = self._grams(k)
        first, second, counts = self.ids[k - 2][level.prefix[order]], self.ids[0][level.word[order]], level.counts[order]

        def columns(s: slice) -> dict:
            a, b = pack_pairs(first[s], second[s])
            return {"a": a, "b": b, "c": pack(counts[s])}

        return self._asks(cut, columns)

    def ask_contexts(self, k: int, unigram: Unigrams, d: dict[int, np.ndarray], learn: bool) -> list[dict]:
        """Contexts with the sums of the n-grams that this block owns, if it learns, and whether it backs off from them."""
        level, counts = self.levels[k - 1], self.counts[k - 1]
        order, cut = self._contexts(k)
        n = len(self.ids[k - 2])
        needs = np.zeros(n, np.uint8)
        needs[level.prefix[counts == 0]] = 1
        sums = []
        if learn:
            at = np.flatnonzero(self.own[k - 1] & (counts > 0))
            lower = self.probabilities(k - 1, unigram, d)[level.suffix[at]]
            sums = [np.bincount(level.prefix[at], x, n)[order] for x in (counts[at], discounted(counts[at], d[k]), lower)]
        ids, needs = self.ids[k - 2][order], needs[order]

        def columns(s: slice) -> dict:
            out = {"a": pack_sorted(ids[s]), "b": pack(needs[s])}
            return out | ({"c": pack(sums[0][s].astype(np.int64)), "d": pack(np.concatenate([x[s] for x in sums[1:]]))} if learn else {})

        return self._asks(cut, columns)

    def _asks(self, cut: np.ndarray, columns: Callable[[slice], dict]) -> list[dict]:
        return [{"part": p, "block": self.number} | columns(slice(cut[p], cut[p + 1])) for p in range(len(cut) - 1) if cut[p + 1] > cut[p]]

    def probabilities(self, k: int, unigram: Unigrams, d: dict[int, np.ndarray]) -> np.ndarray:
        """Of the entries of a level: their own if they were seen, else the context's weight times those a level lower."""
        if k == 1:
            return unigram(self.counts[0])
        level, counts = self.levels[k - 1], self.counts[k - 1]
        lower = self.probabilities(k - 1, unigram, d)[level.suffix]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(counts > 0, discounted(counts, d[k]) / self.over[k][level.prefix], self.weight[k][level.prefix] * lower)


def _pair_order(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    if max(first.max(initial=0), second.max(initial=0)) < np.uint64(1 << 32):
        return np.argsort(first << np.uint64(32) | second, kind="stable")
    return np.lexsort((second, first))


def _by_part(order: np.ndarray, hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """An order made one by part and then as it was, and where each part begins."""
    if not bits:
        return order, np.array([0, len(order)])
    part = (hashes >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.int64)
    by = np.argsort(part, kind="stable")
    return order[by], np.searchsorted(part[by], np.arange((1 << bits) + 1))


def _cuts(sorted_hashes: np.ndarray, bits: int) -> np.ndarray:
    """Where each of 2 ** bits ranges of the hash begins in a sorted array, and the end."""
    inner = (np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, np.uint64)
    return np.concatenate(([0], np.searchsorted(sorted_hashes, inner), [len(sorted_hashes)]))


def _bits(entries: int) -> int:
    return max(0, (max(1, entries) // PART).bit_length())


def _sums(counts: np.ndarray) -> list[int]:
    """What discounts need: n-grams of count 1 to DISCOUNTED + 1, of any, and their counts."""
    seen = counts[counts > 0]
    return [int((seen == r).sum()) for r in range(1, DISCOUNTED + 2)] + [len(seen), int(seen.sum())]


def _split(values: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    return np.split(values, np.cumsum(sizes)[:-1])


def _learn_words(rows: list[dict], bits: int) -> list[dict]:
    hashes = [unpack_sorted(r["a"], np.uint64) for r in rows]
    known, place = np.unique(np.concatenate(hashes), return_inverse=True)
    counts = np.bincount(place, np.concatenate([unpack(r["b"], np.int64) for r in rows]), len(known)).astype(np.int64)
    order, part = np.lexsort((known, -counts)), rows[0]["part"]
    ids = np.empty(len(known), np.uint64)
    ids[order] = (np.arange(len(known), dtype=np.uint64) << np.uint64(bits)) + np.uint64(part)
    sizes = [len(h) for h in hashes]
    out = [{"block": r["block"], "a": pack(i), "b": pack(c)} for r, i, c in zip(rows, _split(ids[place], sizes), _split(counts[place], sizes), strict=True)]
    return [*out, {"a": pack(known[order]), "b": pack(counts[order]), "stats": _sums(counts)}]


def _find_words(rows: list[dict], held: list[dict], bits: int) -> list[dict]:
    known, counts = (np.concatenate([unpack(r[c], t) for r in held]) if held else np.zeros(0, t) for c, t in (("a", np.uint64), ("b", np.int64)))
    order, out = np.argsort(known), []
    for r in rows:
        at, found = _find(known[order], unpack_sorted(r["a"], np.uint64))
        ids = np.full(len(found), _NONE)
        ids[found] = (order[at[found]].astype(np.uint64) << np.uint64(bits)) + np.uint64(r["part"])
        out.append({"block": r["block"], "a": pack(ids), "b": pack(_taken(counts[order], at, found))})
    return out


def _learn_grams(rows: list[dict], bits: int) -> list[dict]:
    pairs = [unpack_pairs(r["a"], r["b"]) for r in rows]
    first, second = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
    order = _pair_order(first, second)
    new = np.ones(len(order), bool)
    new[1:] = (first[order[1:]] != first[order[:-1]]) | (second[order[1:]] != second[order[:-1]])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    owner = np.zeros(len(order), np.uint8)
    owner[order[new]] = 1
    counts = np.bincount(place, np.concatenate([unpack(r["c"], np.int64) for r in rows]), int(new.sum())).astype(np.int64)
    ids = (np.arange(len(counts), dtype=np.uint64) << np.uint64(bits)) + np.uint64(rows[0]["part"])
    sizes = [len(f) for f, _ in pairs]
    parts = zip(rows, *(_split(x, sizes) for x in (counts[place], owner, ids[place])), strict=True)
    a, b = pack_pairs(first[order[new]], second[order[new]])
    return [*({"block": r["block"], "a": pack(c), "b": pack(o), "c": pack(i)} for r, c, o, i in parts), {"a": a, "b": b, "c": pack(counts), "stats": _sums(counts)}]


def _find_grams(rows: list[dict], held: list[dict], bits: int) -> list[dict]:
    first, second = unpack_pairs(held[0]["a"], held[0]["b"]) if held else (np.zeros(0, np.uint64),) * 2
    counts = unpack(held[0]["c"], np.int64) if held else np.zeros(0, np.int64)
    out = []
    for r in rows:
        f, s = unpack_pairs(r["a"], r["b"])
        # Both are in order: what is asked is found behind the equal one that is held.
        order = _pair_order(np.concatenate((first, f)), np.concatenate((second, s)))
        asked = order >= len(first)
        last = np.maximum.accumulate(np.where(asked, -1, np.arange(len(order))))
        at = np.where(last[asked] >= 0, order[np.maximum(last[asked], 0)], -1)
        mine = order[asked] - len(first)
        place = np.full(len(f), -1)
        place[mine] = at
        found = (place >= 0) & (len(first) > 0)
        found[found] = (first[place[found]] == f[found]) & (second[place[found]] == s[found])
        ids = np.full(len(f), _NONE)
        ids[found] = (place[found].astype(np.uint64) << np.uint64(bits)) + np.uint64(r["part"])
        out.append({"block": r["block"], "a": pack(_taken(counts, place, found)), "b": pack(np.zeros(len(f), np.uint8)), "c": pack(ids)})
    return out


def _learn_contexts(rows: list[dict], bits: int) -> list[dict]:
    ids = [unpack_sorted(r["a"], np.uint64) for r in rows]
    known, place = np.unique(np.concatenate(ids), return_inverse=True)
    seen = np.bincount(place, np.concatenate([unpack(r["c"], np.int64) for r in rows]), len(known))
    both = np.concatenate([unpack(r["d"], np.float64).reshape(2, -1) for r in rows], axis=1)
    mass, lower = (np.bincount(place, x, len(known)) for x in both)
    left = seen - mass
    over = np.where(seen > 0, np.where(left > 1e-9 * seen, seen, seen + 1), 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        weight = np.where(seen > 0, (over - mass) / over / (1 - lower), 1.0)
    held = [{"a": pack_sorted(known), "b": pack(over.astype(np.int64)), "c": pack(weight)}]
    return [*_find_contexts(rows, held, bits), *held]


def _find_contexts(rows: list[dict], held: list[dict], bits: int) -> list[dict]:
    known, over, weight = (unpack_sorted(held[0]["a"], np.uint64), unpack(held[0]["b"], np.int64), unpack(held[0]["c"], np.float64)) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0))
    out = []
    for r in rows:
        at, found = _find(known, unpack_sorted(r["a"], np.uint64))
        needs = unpack(r["b"], np.uint8) > 0
        out.append({"block": r["block"], "a": pack(_taken(over, at, found)), "b": pack(np.where(needs, _taken(weight, at, found, 1.0), 0.0))})
    return out


def _find(known: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of sorted values among sorted known ones, and whether they are there."""
    at = np.searchsorted(known, asked)
    found = at < len(known)
    found[found] = known[at[found]] == asked[found]
    return at, found


def _taken(values: np.ndarray, at: np.ndarray, found: np.ndarray, other: float = 0) -> np.ndarray:
    out = np.full(len(at), other, values.dtype)
    out[found] = values[at[found]]
    return out


_LEARN = {"word": _learn_words, "gram": _learn_grams, "context": _learn_contexts}
_FIND = {"word": _find_words, "gram": _find_grams, "context": _find_contexts}


@dataclass
class Model:
    """A learned model: its tables by name, the bits of their partition numbers, and the sums that discounts come from."""

    order: int
    bits: dict[str, int]
    stats: dict[str, list[int]]
    tables: dict[str, DataFrame]

    @property
    def unigram(self) -> Unigrams:
        return Unigrams(self.stats["word"])

    @property
    def discounts(self) -> dict[int, np.ndarray]:
        return {k: discounts(self.stats[f"gram{k}"][: DISCOUNTED + 1]) for k in range(2, self.order + 1) if f"gram{k}" in self.stats}

    def save(self, path: str) -> None:
        for name, table in self.tables.items():
            table.write.parquet(f"{path}/{name}")
            spark = table.sparkSession
        spark.createDataFrame([(json.dumps({"order": self.order, "bits": self.bits, "stats": self.stats}),)], "model string").write.parquet(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        known = json.loads(spark.read.parquet(f"{path}/model").first().model)
        return cls(known["order"], known["bits"], known["stats"], {n: spark.read.parquet(f"{path}/{n}") for n in known["bits"]})


class _Exchange:
    """Blocks of documents and what they ask of a model's tables, learning them on the way or not."""

    def __init__(self, docs: DataFrame, model: Model, learn: bool, tokens: int):
        self.model, self.learn = model, learn
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.packed = materialise_bucketed(blocks(docs, tokens), "katz-blocks", "block", max(1, min(MOST_BUCKETS, size // BUCKET)))
        self.answers: DataFrame | None = None
        self.done: list[str] = []
        if learn:
            words, grams = (int(x or 0) for x in self.packed.agg(F.sum("n_words"), F.sum("n_tokens")).first())
            model.bits |= {"word": _bits(words)}
            for k in range(2, model.order + 1):
                model.bits |= {f"gram{k}": _bits(grams), f"context{k}": _bits(words if k == 2 else grams)}
        for name in ["word", *(f"{kind}{k}" for k in range(2, model.order + 1) for kind in ("gram", "context"))]:
            self._pass(name)
            self.done = [*self.done, name]

    def _grouped(self, run: Callable[[dict, list[dict]], pa.Table], schema: str) -> DataFrame:
        """run of each block and its answers so far."""
        held = self.packed.groupBy("block")
        if self.answers is None:
            return held.applyInArrow(lambda left: _joined([run(r, []) for r in left.to_pylist()], schema), schema)

        def both(left: pa.Table, right: pa.Table) -> pa.Table:
            answers = right.to_pylist()
            return _joined([run(r, answers) for r in left.to_pylist()], schema)

        return held.cogroup(self.answers.groupBy("block")).applyInArrow(both, schema)

    def _pass(self, name: str) -> None:
        """One table: asked by all blocks, its answers kept for them, and itself if it is learned."""
        model, learn, kind, k = self.model, self.learn, name.rstrip("0123456789"), int(name.lstrip("abcdefghijklmnopqrstuvwxyz") or 1)
        bits, order, done = dict(model.bits), model.order, self.done
        unigram, d = (model.unigram, model.discounts) if kind == "context" else (None, None)

        def ask(row: dict, answers: list[dict]) -> pa.Table:
            block = Block(row, order, k, bits, answers, done)
            return _table(block.ask_words() if kind == "word" else block.ask_grams(k) if kind == "gram" else block.ask_contexts(k, unigram, d, learn), _ASK)

        asked = self._grouped(ask, _ASK).repartition(1 << bits[name], "part")
        lean = kind == "gram" and k == order  # the numbers of the longest n-grams are asked by nobody

        def told(rows: list[dict], part: int) -> pa.Table:
            rows = [{"kind": name, "part": part} | r | ({"c": None} if lean and r.get("block") is not None else {}) for r in rows]
            return _table(rows, _ANSWER)

        if learn:
            def answer(left: pa.Table) -> pa.Table:
                rows = left.to_pylist()
                return told(_LEARN[kind](rows, bits[name]), rows[0]["part"])

            made = materialise(asked.groupBy("part").applyInArrow(answer, _ANSWER).withColumn("held", F.col("block").isNull()), f"katz-{name}", "held")
            model.tables[name] = made.where("held").drop("held", "block")
            if kind != "context":
                row = model.tables[name].agg(*(F.sum(F.get("stats", F.lit(i))) for i in range(DISCOUNTED + 3))).first()
                model.stats[name] = [int(x or 0) for x in row]
            made = made.where("not held").drop("held")
        else:
            def find(left: pa.Table, right: pa.Table) -> pa.Table:
                rows = left.to_pylist()
                return told(_FIND[kind](rows, right.to_pylist(), bits[name]), rows[0]["part"]) if rows else _table([], _ANSWER)

            table = model.tables[name].select("part", "a", "b", "c")
            made = materialise(asked.groupBy("part").cogroup(table.groupBy("part")).applyInArrow(find, _ANSWER), f"katz-{name}")
        made = made.drop("stats")
        self.answers = made if self.answers is None else self.answers.unionByName(made)

    def scores(self) -> DataFrame:
        unigram, d, order, bits, done = self.model.unigram, self.model.discounts, self.model.order, dict(self.model.bits), self.done
        total, distinct = unigram.total, unigram.distinct
        schema = "key long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

        def score(row: dict, answers: list[dict]) -> pa.Table:
            block = Block(row, order, order, bits, answers, done)
            p, place, counts = block.probabilities(order, unigram, d), block.levels[-1].place, block.counts[0][block.levels[0].place]
            owner = np.repeat(np.arange(len(block.sizes)), block.sizes)
            add = lambda x: np.bincount(owner, x, len(block.sizes))
            return pa.table({
                "key": pa.array(block.keys, mask=block.flags >= 2), "train": pa.array(block.flags % 2 == 1), "n_tokens": pa.array(block.sizes), "n_known": pa.array(add(counts > 0).astype(np.int64)), "train_tokens": pa.array(np.full(len(block.sizes), total)),
                "base_score": pa.array(add(np.log10((counts + 1) / (total + distinct + 1)))), "score": pa.array(add(np.log10(p)[place])),
            })

        return self._grouped(score, schema)


def _joined(tables: list[pa.Table], schema: str) -> pa.Table:
    return pa.concat_tables(tables) if tables else _table([], schema)


def learn_and_score(docs: DataFrame, order: int = ORDER, tokens: int = BLOCK) -> tuple[Model, DataFrame]:
    """A model of the rows of docs(key long, text string, train boolean) where train holds, and of all rows (key, train,
    n_tokens, n_known, train_tokens, base_score, score): log10 probabilities of whole texts under the add-one unigram and
    the Katz model."""
    if order < 2:
        raise ValueError("a backoff model has an order of 2 at least")
    model = Model(order, {}, {}, {})
    return model, _Exchange(docs, model, True, tokens).scores()


def score_with(model: Model, docs: DataFrame, tokens: int = BLOCK) -> DataFrame:
    """As learn_and_score, for documents that need not be among those the model was learned from."""
    return _Exchange(docs, model, False, tokens).scores()

"""SimHash near-duplicates, compared on bit planes.

A text's fingerprint has bit k set if over half of its word shingles' hashes have it. Fingerprints link if
they differ in at most `radius` bits; components are the connected parts of all links.

Candidates are exact: 64 bits are cut into radius + agree bands, and two fingerprints within the radius agree
in at least `agree` of them, so they share the key of some choice of so many bands. agree is 2 until keys would
have more than MEET fingerprints on average, and then larger; links are the same for any. Fingerprints that
share a key are compared block by block: a block's bits are stored vertically, one plane per bit, and one pass
over the planes adds up 64 distances per word with carry-save counters. (query, word) blocks whose 64
distances all exceed the radius are abandoned on the way. A block returns a spanning forest of its links,
not its pairs, found from the least of each part outwards, so that blocks that hold the same fingerprints return the same
links. A key with more rows than BLOCK is split into blocks by a hash, and each pair of its blocks is a task of its own, so no key
meets in one task.

Components are found by joining nodes to their least neighbours and moving links to the roots, each round written to
the shared folder. Where rows look up a label, component or fingerprint that more than HOT of them share, they do so
without a shuffle (`look_up`).

Defined results: a text without words (null, empty) has fingerprint 0, which links like any other. A text
of fewer words than a shingle is one shingle. Equal texts share a fingerprint and thus a component. Null ids
take part; a component of null ids alone has id null. Extra columns are kept by `components`, and columns of
docs named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldspar.llm._shared import HOT_ROWS, carried, discard, hot_keys, look_up, materialise

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Rows of a key that are compared in one block; a task holds two blocks at most.
BLOCK = 4096
#: Rows of several small keys that share a comparison.
SHARED = 512
#: Fingerprints that share a key by chance, on average, at most.
MEET = 1024
#: One fingerprint in so many tells how many rows a key has, which decides into how many blocks it is split. Links are
#: the same for any number of blocks.
COUNTED = 64
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The XXH64 of each word shingle of a whole text, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    n = max(1, len(words) - shingle + 1)
    begins, ends, hashes = (ends - sizes + 1)[:n].tolist(), ends[len(words) - n :].tolist(), []
    for at in range(0, n, 1 << 14):
        parts = [joined[b:e] for b, e in zip(begins[at : at + (1 << 14)], ends[at : at + (1 << 14)], strict=True)]
        hashes.append(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), np.uint64, len(parts)))
    return np.concatenate(hashes)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    h, counts = shingle_hashes(text, shingle, seed), np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        counts += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """docs with fp, the fingerprint's bits as a signed long."""
    kept = carried(docs, keep, ["fp"])
    source = docs.select(*kept, docs[text_col].alias("__text"))
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), shingle, seed) for t in batch.column(len(kept))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp)], names=[*kept, "fp"])

    return source.mapInArrow(run, schema)


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder: sum and carry bits of three."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints (one 64-bit word each, or a row of words): plane k holds bit k of 64 fingerprints a word, zero beyond
    the last."""
    wide = np.ascontiguousarray(fps).reshape(len(fps), -1)
    bits = np.zeros((-(-len(fps) // 64) * 64, 64 * wide.shape[1]), np.uint8)
    bits[: len(fps)] = np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def close_masks(fps: np.ndarray, radius: int = RADIUS, look: tuple[int, ...] = (20, 28, 40)) -> np.ndarray:
    """For each of n fingerprints a row of ceil(n / 64) words, whose bit j of word w is set if fingerprint
    64 * w + j is within the radius (7 at most). Blocks are dropped at the plane counts in look."""
    if not 0 <= radius <= 7:
        raise ValueError("the counters hold radii of 0 to 7")
    rows, n = planes(fps), len(fps)
    width = rows.shape[1]
    out = np.zeros((n, width), np.uint64)
    valid = np.full(width, _ALL)
    if n % 64:
        valid[-1] = np.uint64((1 << (n % 64)) - 1)
    step = max(1, (1 << 15) // width)
    for first in range(0, n, step):
        asked = fps[first : first + step]
        want = [np.where((asked >> np.uint64(k)) & np.uint64(1), _ALL, np.uint64(0)) for k in range(64)]
        q, w = (x.ravel() for x in np.meshgrid(np.arange(len(asked)), np.arange(width), indexing="ij"))
        ones, twos, fours, over = (np.zeros(len(q), np.uint64) for _ in range(4))
        whole = True
        for k in range(0, 64, 4):
            if whole:
                a, b, c, d = ((rows[k + i][None, :] ^ want[k + i][:, None]).ravel() for i in range(4))
            else:
                a, b, c, d = (rows[k + i][w] ^ want[k + i][q] for i in range(4))
            ones, t1 = _add(ones, a, b)
            ones, t2 = _add(ones, c, d)
            twos, f = _add(twos, t1, t2)
            over |= fours & f
            fours ^= f
            if k + 4 in look or k == 60:
                far = over | _above([ones, twos, fours], radius)
                alive = np.flatnonzero((~far & valid[w]) != 0)
                if k == 60:
                    out[first + q[alive], w[alive]] = ~far[alive] & valid[w[alive]]
                    break
                if len(alive) < len(q):
                    q, w, ones, twos, fours, over = (x[alive] for x in (q, w, ones, twos, fours, over))
                    whole = False
                if not len(q):
                    break
    return out


def _above(lanes: list[np.ndarray], limit: int) -> np.ndarray:
    """Lanes whose count, lowest bit first, is above the limit."""
    out, same = np.zeros_like(lanes[0]), np.full_like(lanes[0], _ALL)
    for k in reversed(range(len(lanes))):
        if limit >> k & 1:
            same &= lanes[k]
        else:
            out |= same & lanes[k]
            same &= ~lanes[k]
    return out


def within(asked: np.ndarray, prints: np.ndarray, limit: int, look: int = 128) -> np.ndarray:
    """For each of asked (a row of words each) a row of ceil(n / 64) words, whose bit j of word w is set if print 64 * w + j differs
    from it in at most `limit` bits. Eight planes at a time go through a tree of carry-save adders into counters of as
    many bits as the limit has; blocks are dropped every `look` planes once all their counts are above it."""
    rows, n = planes(prints), len(prints)
    width = rows.shape[1]
    out = np.zeros((len(asked), width), np.uint64)
    valid = np.full(width, _ALL)
    if n % 64:
        valid[-1] = np.uint64((1 << (n % 64)) - 1)
    size = max(4, limit.bit_length())
    step = max(1, (1 << 14) // width)
    for first in range(0, len(asked), step):
        part = asked[first : first + step]
        q, w = (x.ravel() for x in np.meshgrid(np.arange(len(part)), np.arange(width), indexing="ij"))
        counts, over = [np.zeros(len(q), np.uint64) for _ in range(size)], np.zeros(len(q), np.uint64)
        for k in range(0, len(rows), 8):
            want = np.where((part[:, k // 64, None] >> np.arange(k % 64, k % 64 + 8, dtype=np.uint64)) & np.uint64(1), _ALL, np.uint64(0))
            a, b, c, d, e, f, g, h = (rows[k + i][w] ^ want[q, i] for i in range(8))
            counts[0], t1 = _add(counts[0], a, b)
            counts[0], t2 = _add(counts[0], c, d)
            counts[1], f1 = _add(counts[1], t1, t2)
            counts[0], t1 = _add(counts[0], e, f)
            counts[0], t2 = _add(counts[0], g, h)
            counts[1], f2 = _add(counts[1], t1, t2)
            counts[2], carry = _add(counts[2], f1, f2)
            for j in range(3, size):
                counts[j], carry = counts[j] ^ carry, counts[j] & carry
            over |= carry
            last = k + 8 >= len(rows)
            if last or (k + 8) % look == 0:
                far = over | _above(counts, limit)
                alive = np.flatnonzero((~far & valid[w]) != 0)
                if last:
                    out[first + q[alive], w[alive]] = ~far[alive] & valid[w[alive]]
                elif len(alive) < len(q):
                    q, w, over = q[alive], w[alive], over[alive]
                    counts = [x[alive] for x in counts]
                if not len(q):
                    break
    return out


def forest(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Positions (one, other) of links that span the linked parts of a block, each part from its least row outwards."""
    masks = close_masks(fps, radius)
    links = [int.from_bytes(m.tobytes(), "little") for m in masks]
    left, out = (1 << len(fps)) - 1, []
    while left:
        root = (left & -left).bit_length() - 1
        left &= left - 1
        part, at = [root], 0
        while at < len(part) and left:
            new = links[part[at]] & left
            left &= ~new
            while new:
                low = new & -new
                new ^= low
                part.append(low.bit_length() - 1)
                out.append((part[at], part[-1]))
            at += 1
    return out


def bands(radius: int = RADIUS, agree: int = 2) -> list[tuple[int, int]]:
    """(shift, width) of radius + agree bands that cover 64 bits."""
    n, out, at = radius + agree, [], 0
    for i in range(n):
        width = 64 // n + (i < 64 % n)
        out.append((at, width))
        at += width
    return out


def agreeing(n: int, radius: int = RADIUS) -> int:
    """Bands that a key is made of: so many that n fingerprints leave no more than MEET to a key by chance."""
    agree = 2
    while agree < 6 and n > MEET << (64 // (radius + agree) * agree):
        agree += 1
    return agree


def _keys(fp: Column, radius: int, agree: int) -> list[Column]:
    """One key for each choice of bands: its number above the bands' bits."""
    out = []
    for t, chosen in enumerate(combinations(bands(radius, agree), agree)):
        key, at = F.lit(0).cast("long"), 0
        for shift, width in chosen:
            part = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1)).cast("long")
            key, at = key.bitwiseOR(F.shiftleft(part, at)), at + width
        out.append(key.bitwiseOR(F.lit(t << at).cast("long")))
    return out


def links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK, agree: int | None = None) -> DataFrame:
    """Edges (a, b) between the fps of distinct(fp) that join all within the radius: enough to span each component."""
    agree = agree or agreeing(distinct.count(), radius)
    keys = F.array(*_keys(F.col("fp"), radius, agree))
    keyed = distinct.select("fp", F.explode(keys).alias("key"))
    counted = distinct.where(F.pmod(F.xxhash64(F.lit(1), "fp"), F.lit(COUNTED)) == 0).select(F.explode(keys).alias("key"))
    large = counted.groupBy("key").agg((F.count(F.lit(1)) * COUNTED).alias("n")).where(F.col("n") > block)
    rows = keyed.join(materialise(large, "simhash-keys"), "key", "left").withColumn("parts", F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    rows = rows.select("fp", "key", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    rows = rows.select("fp", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("meeting"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_at = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def found(fps: np.ndarray) -> pa.RecordBatch:
            fps = np.unique(fps)
            ends = fps[np.array(forest(fps, radius), np.int64).reshape(-1, 2)].view(np.int64)
            return pa.record_batch({"a": ends.min(axis=1), "b": ends.max(axis=1)})

        for batch in batches:
            held = np.concatenate((held, batch["fp"].to_numpy().view(np.uint64)))
            held_at = np.concatenate((held_at, batch["meeting"].to_numpy(zero_copy_only=False)))
            # Meetings that end within what is held, without those of one row; several small ones share a comparison.
            ends = np.flatnonzero(held_at[1:] != held_at[:-1]) + 1
            if not len(ends):
                continue
            whole, whole_at = held[: ends[-1]], held_at[: ends[-1]]
            held, held_at = held[ends[-1] :], held_at[ends[-1] :]
            same = whole_at[1:] == whole_at[:-1]
            met = np.concatenate((same, [False])) | np.concatenate(([False], same))
            whole, whole_at = whole[met], whole_at[met]
            ends, at = np.append(np.flatnonzero(whole_at[1:] != whole_at[:-1]) + 1, len(whole_at)), 0
            while at < len(whole):
                fit = ends[(ends > at) & (ends <= at + SHARED)]
                end = int(fit[-1]) if len(fit) else int(ends[np.searchsorted(ends, at, side="right")])
                yield found(whole[at:end])
                at = end
        if len(held) > 1:
            yield found(held)

    met = rows.repartition("meeting").sortWithinPartitions("meeting")
    return met.mapInArrow(compare, "a long, b long").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges(a, b): the least node of its component.

    In each round every node joins its least neighbour, the trees that this makes are flattened, and links move to their
    roots, where most become loops or equal to others and go; at least every second node goes with them."""
    ends = lambda x: x.select("a", "b").unionByName(x.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels: DataFrame | None = None
    given = edges
    while True:
        held = materialise(ends(edges).groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root")), "simhash-roots")
        roots = held
        if roots.isEmpty():
            discard(edges if edges is not given else None)
            return roots.withColumnRenamed("root", "label") if labels is None else labels
        while True:
            above = roots.select(F.col("node").alias("root"), F.col("root").alias("above"))
            new = materialise(look_up(roots, above, "root", ["above"], F.col("node"), hot_keys(roots, "root")).select("node", "root", "above"), "simhash-roots")
            discard(held)
            held, roots = new, new.select("node", F.col("above").alias("root"))
            if new.where("root <> above").isEmpty():
                break
        moved = edges
        for end in ("a", "b"):
            other = "b" if end == "a" else "a"
            at = roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
            moved = look_up(moved, at, end, [f"root_{end}"], F.col(other), hot_keys(moved, end))
        moved = moved.where("root_a <> root_b").select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct()
        moved = materialise(moved, "simhash-edges")
        discard(edges if edges is not given else None)
        edges = moved
        if labels is None:
            labels = roots.withColumnRenamed("root", "label")
        else:
            further = roots.select(F.col("node").alias("label"), F.col("root").alias("further"))
            known = look_up(labels, further, "label", ["further"], F.col("node"), hot_keys(labels, "label"))
            labels = materialise(known.select("node", F.coalesce("further", "label").alias("label")), "simhash-labels")
            discard(held)


def components(docs: DataFrame, text_col: str = "text", key_col: str = "doc_id", radius: int = RADIUS, keep: list[str] | None = None, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """docs with fingerprint (16 hex digits), component_id (least key reachable) and component (its least
    fingerprint, which tells components apart even where keys are null)."""
    kept = carried(docs, keep, ["fingerprint", "component_id", "component", "fp"])
    row = [F.struct(*(F.col(f"`{c}`") for c in kept)).alias("__row")] if kept else []
    slim = keep is not None and text_col not in kept
    source = lambda own: docs.select(F.col(key_col).alias("__key"), F.col(text_col).alias("__text"), *own)
    small = materialise(fingerprints(source(row if slim else []), "__text", ["__key", *(["__row"] if row and slim else [])], shingle, seed), "simhash-fp")
    # Null keys come last.
    order = F.struct(F.col("__key").isNull().alias("none"), F.col("__key").alias("key"))
    nodes = materialise(small.groupBy("fp").agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    labels = connected(materialise(links(nodes.select("fp"), radius), "simhash-edges"))
    named = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("label", "fp"))
    named = materialise(named.select("fp", "n", "least", "component"), "simhash-named")
    of = materialise(named.groupBy("component").agg(F.min("least").alias("first")), "simhash-firsts")
    found = materialise(look_up(named, of, "component", ["first"], F.col("fp"), hot_keys(named, "component")).select("fp", "component", "n", "first"), "simhash-components")
    rows = small if slim else fingerprints(source(row), "__text", ["__key", *(["__row"] if row else [])], shingle, seed)
    hot = found.where(F.col("n") > HOT_ROWS).select("fp")
    told = look_up(rows, found.select("fp", "component", F.col("first.key").alias("component_id")), "fp", ["component", "component_id"], F.col("__key"), hot)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return told.select(*(["__row.*"] if row else []), hexed.alias("fingerprint"), "component_id", "component")

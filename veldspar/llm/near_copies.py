"""Groups of near copies: SimHash candidates on bit planes, each link held against the exact similarity of its two texts.

Two texts are near copies if their sets of word shingles have a Jaccard similarity of `least` or more. A pair is compared if
its sets share one of BANDS keys (made of ROWS minima each; 0.998 of the pairs at 0.8 do) and it is a candidate if the
SimHash prints of the sets, PRINTS times 64 bits, differ in a share FAR of them at most (texts at 0.8 differ in 0.152, by 0.011 more or
less, so this passes all but one in a thousand of them). Both depend on the two texts alone. A text has BANDS keys at any size of
the corpus.

The prints of a block are compared as bit planes: one pass over the planes adds up 64 distances a word with carry-save counters, and
blocks of which all distances are too large are abandoned on the way. A block gives a spanning forest of its candidates, not its
pairs. The parts that all forests join hold every pair that is to be compared. The sets of such a part move to one place, once,
and are searched there from one text outwards: pairs that share a key and are candidates are held against the sets, and each link found is one
that holds. So nothing is asked twice, a failing link never stands in the place of one that holds, and no third text has a say in whether two are linked.
Keys of more than BLOCK texts, and parts of more than TESTED texts or WORDS shingles, are split by a hash, and each pair of the pieces is a block. A large
part of small keys is dealt out by its keys instead, if that moves less.

Defined results: texts of equal sets are one node (texts without words among them), told apart by 64-bit hashes of the sets. A text of fewer
words than a shingle is one shingle. Null ids come last. `first_rows` tells rows apart by a 128-bit hash of all their columns;
rows that are equal in all of them are one. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.llm._shared import HOT_ROWS, discard, hot_keys, look_up, materialise, row_key
from veldspar.llm.simhash import SEED, connected, shingle_hashes, within

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 12, 4
PRINTS, FAR = 16, 0.19
#: Texts of a key that are compared in one block; a task holds two at most.
BLOCK = 4096
#: Texts whose sets are held against each other in one block, and their shingles; a task holds twice as many at most.
TESTED, WORDS = 2048, 1 << 20
#: Texts of several small keys that share a comparison.
SHARED = 512
#: Rows of 16 bytes that are broadcast, at most.
BROADCAST = 1_000_000

_EIGHTHS = np.uint64(0x0101010101010101)
_GROWN = np.arange(1, 1 + max(PRINTS, BANDS * ROWS), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _mixes(h: np.ndarray, n: int) -> np.ndarray:
    """n further hashes of each hash, a row each."""
    x = h[None, :] + _GROWN[:n, None]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bit_counts(words: np.ndarray) -> np.ndarray:
    """For each row of 64-bit words how many of them have bit 0, 1, ..., 63. Every eighth bit is put into bytes of its own, which hold the
    sums of 255 words."""
    rows, n = words.shape
    step = max(1, min(255, n))
    if n % step:
        words = np.concatenate((words, np.zeros((rows, -n % step), np.uint64)), axis=1)
    out = np.empty((rows, 8, 8), np.int64)
    for k in range(8):
        sums = ((words >> np.uint64(k)) & _EIGHTHS).reshape(rows, -1, step).sum(axis=2, dtype=np.uint64)
        out[:, :, k] = sums.view(np.uint8).reshape(rows, -1, 8).sum(axis=1, dtype=np.int64)
    return out.reshape(rows, 64)


def signature(words: np.ndarray) -> tuple[int, bytes, list[int]]:
    """Of a set of shingle hashes: the set's hash, its prints, and its keys."""
    sums, least = np.zeros((PRINTS, 64), np.int64), np.full(BANDS * ROWS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(words), 1 << 11):
        mixed = _mixes(words[at : at + (1 << 11)], BANDS * ROWS)
        least = np.minimum(least, mixed.min(axis=1))
        sums += bit_counts(mixed[:PRINTS])
    prints = np.packbits(2 * sums > len(words), axis=1, bitorder="little").tobytes()
    keys = [xxhash.xxh64_intdigest(row.tobytes(), nth) for nth, row in enumerate(least.reshape(BANDS, ROWS))]
    return xxhash.xxh64_intdigest(words.tobytes(), SEED), prints, keys


def signatures(docs: DataFrame, text_col: str, kept: list[str], shingle: int = SHINGLE, sets: bool = False) -> DataFrame:
    """docs with node, prints (binary), keys, and size, that of the set; with sets also with words, the set, and then each task
    gives each node once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            words = [np.unique(shingle_hashes(t.as_py(), shingle)) for t in batch.column(len(kept))]
            found = [signature(x) for x in words]
            node, keys = (np.array([x[k] for x in found], np.uint64).view(np.int64) for k in (0, 2))
            columns = [*batch.columns[:-1], pa.array(node), pa.array([x[1] for x in found], pa.binary()), pa.array(list(keys), pa.list_(pa.int64())), pa.array([len(x) for x in words], pa.int64())]
            if sets:
                columns.append(pa.array([x.view(np.int64) for x in words], pa.list_(pa.int64())))
            out = pa.RecordBatch.from_arrays(columns, names=[*kept, *new])
            if sets:
                out = out.filter(pa.array([x not in seen and not seen.add(x) for x in node.tolist()], pa.bool_()))
            yield out

    new = ["node", "prints", "keys", "size", *(["words"] if sets else [])]
    source = docs.select(*kept, F.col(text_col).alias("__text"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.select(*kept).schema.fields)
    return source.mapInArrow(run, f"{fields}, node long, prints binary, keys array<long>, size long" + ", words array<long>" * sets)


def _set_bits(masks: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(np.unpackbits(masks.view(np.uint8), axis=1, bitorder="little")[:, :n])


def forest(prints: np.ndarray, meetings: np.ndarray | None = None, limit: int = int(FAR * 64 * PRINTS)) -> list[tuple[int, int]]:
    """Links (one, other) that span the candidates of a block. Rows of several meetings are linked within each alone; a single large
    meeting is searched from its first row outwards, and only what is not reached yet is compared."""
    n = len(prints)
    if meetings is not None:
        one, other = _set_bits(within(prints, prints, limit), n)
        some = (one < other) & (meetings[one] == meetings[other])
        one, other = one[some], other[some]
        return [(int(one[k]), int(other[k])) for k in _spanning(n, one, other)]
    left, out = np.arange(n), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            asked, queue = queue[:64], queue[64:]
            near = np.unpackbits(within(prints[asked], prints[left], limit).view(np.uint8), axis=1, bitorder="little")[:, : len(left)].astype(bool)
            first, any_near = near.argmax(axis=0), near.any(axis=0)
            out += [(asked[i], int(j)) for i, j in zip(first[any_near].tolist(), left[any_near].tolist(), strict=True)]
            queue += left[any_near].tolist()
            left = left[~any_near]
    return out


def _spanning(n: int, one: np.ndarray, other: np.ndarray) -> list[int]:
    """Places of those links between n parts, in their order, that join what those before don't; it ends once all are joined."""
    parent, out = list(range(n)), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for k, (i, j) in enumerate(zip(one.tolist(), other.tolist(), strict=True)):
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append(k)
            if len(out) == n - 1:
                break
    return out


def _as_prints(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def dealt(rows: DataFrame, large: DataFrame) -> DataFrame:
    """rows(unit, node, ...) under a meeting: their unit, or, of those in large(unit, parts), which are few, each pair of their part
    with another."""
    x = rows.join(F.broadcast(large), "unit", "left").withColumn("parts", F.coalesce("parts", F.lit(1)).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    x = x.select(*rows.columns, own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    return x.select(F.xxhash64("unit", F.least("own", "other"), F.greatest("own", "other")).alias("meeting"), *(c for c in rows.columns if c != "unit"))


def meetings(nodes: DataFrame, block: int) -> DataFrame:
    """(meeting, node, prints): every node under each of its keys, large keys split into blocks that meet in pairs."""
    counted = nodes.select(F.explode("keys").alias("unit")).groupBy("unit").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    return dealt(nodes.select("node", "prints", F.explode("keys").alias("unit")), materialise(counted.where("parts > 1"), "near-keys"))


def candidates(met: DataFrame) -> DataFrame:
    """(a, b): links that span the candidates of each meeting, by estimate."""

    def found(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        at, node, prints = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.lexsort((node, at))
        order = order[np.concatenate(([True], (node[order][1:] != node[order][:-1]) | (at[order][1:] != at[order][:-1])))]
        at, node, prints = at[order], node[order], prints[order]
        links = np.array(forest(prints, at if len(node) <= SHARED else None), np.int64).reshape(-1, 2)
        ends = node[links]
        return pa.record_batch({"a": ends.min(axis=1), "b": ends.max(axis=1)})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # whole meetings that share the next comparison
        rest: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # of the meeting that is being read
        size = 0
        for batch in batches:
            at, node = (batch[c].to_numpy() for c in ("meeting", "node"))
            prints = _as_prints(batch["prints"])
            bounds = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
            for i, j in zip(bounds, bounds[1:], strict=False):
                if rest and (i == j or rest[0][0][0] != at[i]):
                    n = sum(len(x[0]) for x in rest)
                    if n > 1:
                        if held and size + n > SHARED:
                            yield found(held)
                            held, size = [], 0
                        held, size = held + rest, size + n
                    rest = []
                if j > i:
                    rest.append((at[i:j], node[i:j], prints[i:j]))
        n = sum(len(x[0]) for x in rest)
        if held and size + n > SHARED:
            yield found(held)
            held = []
        if n > 1:
            held = held + rest
        if held:
            yield found(held)

    return met.repartition("meeting").sortWithinPartitions("meeting").mapInArrow(compare, "a long, b long").distinct()


def linked(prints: np.ndarray, keys: np.ndarray, words: np.ndarray, sizes: np.ndarray, least: float, limit: int = int(FAR * 64 * PRINTS)) -> list[tuple[int, int]]:
    """Links (one, other) that span the parts of a block whose texts share a key, are candidates, and have the similarity. words: the sets one
    after the other. Each text is asked once, and only for texts that are not reached yet."""
    begins = np.cumsum(sizes) - sizes
    places = np.unique(words, return_inverse=True)[1].astype(np.int32)
    marked, left, out = np.zeros(len(words), bool), np.ones(len(sizes), bool), []
    for start in range(len(sizes)):
        if not left[start]:
            continue
        left[start], queue = False, [start]
        for i in queue:
            js = np.flatnonzero(left)
            js = js[(keys[js] == keys[i]).any(axis=1)]
            js = js[np.bitwise_count(prints[js] ^ prints[i]).sum(axis=1, dtype=np.int64) <= limit]
            js = js[np.minimum(sizes[js], sizes[i]) >= least * np.maximum(sizes[js], sizes[i])]
            if not len(js):
                continue
            ends = np.cumsum(sizes[js])
            at = np.arange(ends[-1]) + np.repeat(begins[js] - ends + sizes[js], sizes[js])
            own = places[begins[i] : begins[i] + sizes[i]]
            marked[own] = True
            both = np.add.reduceat(marked[places[at]], ends - sizes[js], dtype=np.int64)
            marked[own] = False
            js = js[both >= least * (sizes[i] + sizes[js] - both)]
            left[js] = False
            queue += js.tolist()
            out += [(i, j) for j in js.tolist()]
    return out


def units(nodes: DataFrame, parts: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """How the sets of parts(node, label) meet: (a, b, label, by_key) of a row with the text of each node, by_key where a part is dealt out by its
    keys and not as a whole, and large(unit, parts) of what is then split."""
    pieces = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("size") / WORDS)).alias("parts")
    near = F.broadcast(parts) if parts.count() <= BROADCAST else parts
    held = materialise(nodes.join(near, "node").select("node", "label", "keys", "size", "least.row.a", "least.row.b"), "near-held")
    large = materialise(held.groupBy("label").agg(pieces, F.count(F.lit(1)).alias("n")).where("parts > 1"), "near-large")
    keyed = held.join(F.broadcast(large.select("label")), "label", "left_semi").select("label", "size", F.explode("keys").alias("key"))
    keyed = materialise(keyed.groupBy("label", "key").agg(pieces, F.count(F.lit(1)).alias("n")), "near-keyed")
    moved = keyed.groupBy("label").agg(F.sum(F.col("n") * F.col("parts")).alias("moved"))
    by_key = materialise(large.join(moved, "label").where(F.col("moved") < F.col("n") * F.col("parts")).select("label", F.lit(True).alias("by_key")), "near-by-key")
    split = large.join(F.broadcast(by_key), "label", "left_anti").select(F.col("label").alias("unit"), "parts")
    split = split.unionByName(keyed.where("parts > 1").join(F.broadcast(by_key), "label", "left_semi").select(F.xxhash64("label", "key").alias("unit"), "parts"))
    asked = held.join(F.broadcast(by_key), "label", "left").select("a", "b", "label", F.coalesce("by_key", F.lit(False)).alias("by_key"))
    made = materialise(asked, "near-asked"), materialise(split, "near-split")
    discard(held, large, keyed, by_key)
    return made


def links(sets: DataFrame, large: DataFrame, least: float) -> DataFrame:
    """(a, b): links that hold, of sets(label, by_key, node, prints, keys, words), which span all that hold."""

    def search(texts: pa.Table) -> pa.Table:
        node, first = np.unique(texts["node"].to_numpy(), return_index=True)
        texts = texts.take(pa.array(first))
        words = texts["words"].combine_chunks()
        sizes = np.array(words.value_lengths(), np.int64)
        keys = texts["keys"].combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        pairs = linked(_as_prints(texts["prints"]), keys, words.flatten().to_numpy(), sizes, least)
        ends = node[np.array(pairs, np.int64).reshape(-1, 2)]
        return pa.table({"a": ends.min(axis=1), "b": ends.max(axis=1)})

    of = F.when(F.col("by_key"), F.transform("keys", lambda k: F.xxhash64("label", k))).otherwise(F.array("label"))
    met = dealt(sets.select(F.explode(of).alias("unit"), "node", "prints", "keys", "words"), large)
    return met.groupBy("meeting").applyInArrow(search, "a long, b long").distinct()


def _with_rows(docs: DataFrame, key: Column) -> DataFrame:
    """docs as one column beside the two hashes, a and b, that tell rows apart."""
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__docs"), key.alias("__row"))
    return keyed.select("__docs", F.col("__row.a").alias("a"), F.col("__row.b").alias("b"))


def _beside(rows: DataFrame, how: str, few: DataFrame) -> DataFrame:
    """A join on the two hashes in which rows stay where they are as long as the others are few."""
    return rows.join(F.broadcast(few) if few.count() <= BROADCAST else few, ["a", "b"], how)


def groups(docs: DataFrame, text_col: str, key_col: str, shingle: int = SHINGLE, least: float = LEAST, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(key, node) of all rows, key being (none, key, row), and (node, component, n, first) of all nodes: the group, the rows, and the
    group's least key."""
    row = row_key(docs)
    key = F.struct(F.col(f"`{key_col}`").isNull().alias("none"), F.col(f"`{key_col}`").alias("key"), row.alias("row"))
    small = materialise(signatures(docs.select(key.alias("key"), F.col(f"`{text_col}`").alias("text")), "text", ["key"], shingle), "near-signatures")
    entry = [F.min("key").alias("least"), *(F.first(c).alias(c) for c in ("prints", "keys", "size")), F.count(F.lit(1)).alias("n")]
    nodes = materialise(small.groupBy("node").agg(*entry), "near-nodes")
    found = materialise(candidates(meetings(nodes, block)), "near-candidates")
    asked, large = units(nodes, connected(found), min(block, TESTED))
    texts = _beside(_with_rows(docs, row), "inner", asked).select("label", "by_key", F.col("__docs")[text_col].alias("text"))
    edges = materialise(links(signatures(texts, "text", ["label", "by_key"], shingle, sets=True), large, least), "near-edges")
    labels = connected(edges)
    discard(found)
    named = nodes.join(labels, "node", "left").select("node", "n", "least", F.coalesce("label", "node").alias("component"))
    named = materialise(named, "near-named")
    firsts = materialise(named.groupBy("component").agg(F.min("least").alias("first")), "near-firsts")
    found = look_up(named, firsts, "component", ["first"], F.col("node"), hot_keys(named, "component"))
    made = materialise(found.select("node", "component", "n", "first"), "near-groups")
    discard(asked, large, edges, nodes, named, firsts)
    return small.select("key", "node"), made


def _told(small: DataFrame, found: DataFrame) -> DataFrame:
    hot = found.where(F.col("n") > HOT_ROWS).select("node")
    return look_up(small, found, "node", ["component", "first"], F.col("key"), hot)


def components(docs: DataFrame, text_col: str = "text", key_col: str = "doc_id", **how) -> DataFrame:
    """(key_col, component_id, component) of every row: the least key of its group, and a number that tells groups apart even where
    keys are null."""
    return _told(*groups(docs, text_col, key_col, **how)).select(F.col("key.key").alias(key_col), F.col("first.key").alias("component_id"), "component")


def first_rows(docs: DataFrame, text_col: str = "text", key_col: str = "doc_id", **how) -> DataFrame:
    """The row of the least key of each group, ties by the hash of the whole row. Texts stay where they are up to BROADCAST
    rows that go; beyond, they move once. Of equal rows one stays."""
    told = _told(*groups(docs, text_col, key_col, **how))
    counted = told.groupBy(F.col("key.row").alias("row"), (~F.col("key").eqNullSafe(F.col("first"))).alias("goes")).agg(F.count(F.lit(1)).alias("n"))
    # Rows that go, and rows that stay but stand there more than once; of all others nothing is asked.
    ruled = materialise(counted.where("goes or n > 1").select("row.a", "row.b", "goes"), "near-ruled")
    keyed = _with_rows(docs, row_key(docs))
    single = _beside(keyed, "left_anti", ruled)
    if ruled.where("not goes").isEmpty():
        return single.select("__docs.*")
    repeated = keyed.join(ruled.where("not goes"), ["a", "b"], "left_semi").groupBy("a", "b").agg(F.first("__docs").alias("__docs"))
    return single.select("__docs").unionByName(repeated.select("__docs")).select("__docs.*")

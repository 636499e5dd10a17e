"""Context assembly: duplicates, ranking by a query, compression and token budgets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veldspar.functions import text as X
from veldspar.operators.providers import Provider, generate
from veldspar.operators.scratch import discard, materialise

#: Rows of a word that meet in one task; more are split, and each pair of splits is a task of its own.
SPLIT = 4096
#: Meetings of a task, about, and tasks of a join at most.
MET, TASKS = 10_000_000, 20_000


def first_by(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key. The winner's order is found with a combinable aggregate, so a hot key is
    not sorted in one task."""
    keyed = rows.withColumn("__key", key)
    first = keyed.groupBy("__key").agg(F.min(order).alias(order))
    return keyed.join(first.select("__key", order), ["__key", order], "left_semi").drop("__key")


def first_by_prefix(rows: DataFrame, text_col: str, order: str, chars: int = 200) -> DataFrame:
    """Rows whose trimmed, lowered prefix was not seen before."""
    return first_by(rows, F.substring(F.lower(F.trim(text_col)), 1, chars), order)


def meetings(rows: DataFrame, key: str, columns: list[str], search: Callable[..., tuple[np.ndarray, np.ndarray]] | None = None) -> DataFrame:
    """Pairs of rows that share a key, (a_..., b_...) in both orders and of a row with itself. A key of more than SPLIT
    rows is cut into parts by a hash, so that no key meets in one task.

    With a search, the parts meet in Python: it gets whole groups of long columns at a time, as search(group, side, columns by name), and gives the positions of
    the pairs that it looks for; of two parts, only rows of different sides are to be paired. The pairs are (a_, b_) of the first column."""
    spark = rows.sparkSession
    sizes = materialise(rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1"), "meeting-sizes")
    # Tasks are as many as the meetings ask for: rows that are few in bytes would be put in one.
    met = sizes.agg(F.sum(F.col("__n").cast("double") * F.col("__n")).alias("m")).first().m or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(int(met / MET), TASKS))
    # Keys of more than SPLIT rows are few: one for SPLIT rows at most.
    x = rows.join(F.broadcast(sizes.where(F.col("__n") > SPLIT)), key, "left").withColumn("__parts", F.coalesce(F.ceil(F.col("__n") / SPLIT), F.lit(1)).cast("int"))
    x = x.withColumn("__own", F.pmod(F.xxhash64(*columns), F.col("__parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))
    dealt = [key, "__p", "__q"]
    if search is not None:
        x = x.select(key, "__own", every.alias("__other"), *columns)
        x = x.select(key, F.least("__own", "__other").alias("__p"), F.greatest("__own", "__other").alias("__q"), (F.col("__own") > F.col("__other")).cast("int").alias("__side"), *columns)
        first, kind = columns[0], dict(rows.dtypes)[columns[0]]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in whole_groups(batches, dealt):
                held = {c: table[c].to_numpy() for c in ["__side", *columns]}
                a, b = search(group_numbers(table, dealt), held["__side"], held)
                yield pa.RecordBatch.from_arrays([pa.array(held[first][a]), pa.array(held[first][b])], names=[f"a_{first}", f"b_{first}"])

        return x.repartition(tasks, *dealt).sortWithinPartitions(*dealt).mapInArrow(run, f"a_{first} {kind}, b_{first} {kind}")
    left = x.select(key, F.col("__own").alias("__p"), every.alias("__q"), *(F.col(c).alias(f"a_{c}") for c in columns))
    right = x.select(key, every.alias("__p"), F.col("__own").alias("__q"), *(F.col(c).alias(f"b_{c}") for c in columns))
    return left.repartition(tasks, *dealt).join(right.repartition(tasks, *dealt), dealt)


#: Rows that whole_groups gives at a time, about, unless a group has more.
GROUPED = 50_000


def group_numbers(table: pa.Table, keys: list[str]) -> np.ndarray:
    """The number of each row's group, of rows in order of their keys."""
    new = np.zeros(max(table.num_rows - 1, 0), bool)
    for k in keys:
        v = table[k].to_numpy()
        new |= v[1:] != v[:-1]
    return np.concatenate([[0], np.cumsum(new)])[: table.num_rows]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows in order of their keys as tables of whole groups."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        # What is held before ends where a batch begins another group.
        held.append(batch)
        if sum(b.num_rows for b in held) < GROUPED:
            continue
        number = group_numbers(pa.Table.from_batches([batch]), keys)
        last = int(np.searchsorted(number, number[-1]))
        before = pa.Table.from_batches([*held[:-1], batch.slice(0, last)])
        if last:
            yield before
            held = [batch.slice(last)]
        elif before.num_rows and any(before[k][-1].as_py() != batch.column(k)[0].as_py() for k in keys):
            yield before
            held = [batch]
    if held:
        yield pa.Table.from_batches(held)


#: Longs of a set's bits.
BITS = 4
#: Words that are ranked by how many sets have them, at most; the others are rarer and come before them, in order of their hash.
LISTED = 100_000
#: Pairs that are looked at together, and pairs of sets that are compared in one group, about.
LOOKED, COMPARED = 500_000, 100_000


def hashed(words: Column) -> Column:
    """The 64-bit hashes of a set of words, in order. Two of n words have one hash n^2 / 2^65 times."""
    return F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))


def ranks(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The words that most of sets(h) have, LISTED of them at most, in order of their hash, and their ranks, the more frequent the higher."""
    df = sets.select(F.explode("h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    df = materialise(df.withColumn("step", F.floor(8 * F.log2("df"))), "word-counts")
    # Steps of frequency are listed whole, so that no task sends more to the driver than is listed.
    steps, listed, least = df.groupBy("step").count().orderBy(F.desc("step")).collect(), 0, None
    for r in steps:
        listed += r["count"]
        if listed > LISTED:
            break
        least = r.step
    top = df.where(F.col("step") >= F.lit(least)).select("h", "df").toPandas()
    h, n = (top[c].to_numpy(np.int64) for c in ("h", "df"))
    order = np.lexsort((h, n))
    rank = np.empty(len(h), np.int64)
    rank[order] = np.arange(1, len(h) + 1)
    order = np.argsort(h)
    return h[order], rank[order]


def lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of lists, one list after the other, and the lists' sizes."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def beginnings(sets: DataFrame, least: float) -> DataFrame:
    """(gram, doc_id, place, before, bits...): the words of sets(doc_id, h) that the search looks at, of each set the first n - ceil(least * n) + 1 in order of
    their ranks; place is n * 2^32 + the word's number from 1, before the word before, and a bit says whether an odd number of the set's words fall on it."""
    listed, rank = ranks(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                flat, n = lists(part.column(1))
                row = np.repeat(np.arange(len(n)), n)
                found = np.minimum(np.searchsorted(listed, flat), max(len(listed) - 1, 0))
                by = np.where(listed[found] == flat, rank[found], 0) if len(listed) else np.zeros(len(flat), np.int64)
                flat_sorted = flat[np.argsort(row * (LISTED + 1) + by, kind="stable")]
                odd = np.bincount(row * 64 * BITS + (flat & (64 * BITS - 1)), minlength=len(n) * 64 * BITS) & 1
                bits = np.packbits(odd.astype(np.uint8).reshape(len(n), 64 * BITS), axis=1).view(np.int64)
                number = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n) + 1
                kept = np.flatnonzero(number <= np.repeat(n - np.ceil(n * least - 1e-9) + 1, n))
                before = flat_sorted[kept - 1]  # of a first word it means nothing
                columns = [flat_sorted[kept], part.column(0).to_numpy()[row[kept]], (n[row[kept]].astype(np.int64) << 32) + number[kept], before, *bits[row[kept]].T]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["gram", "doc_id", "place", "before", *(f"bits{i}" for i in range(BITS))])

    return sets.select("doc_id", "h").mapInArrow(run, "gram long, doc_id long, place long, before long, " + ", ".join(f"bits{i} long" for i in range(BITS)))


def near_sets(least: float) -> Callable[..., tuple[np.ndarray, np.ndarray]]:
    """A search for meetings of beginnings(): positions of pairs that may be this similar.

    The smaller set y of a pair, or the one of the lesser id, has its first word in common among its first n - ceil(2 * least / (1 + least) * n) + 1, and what follows that word in either must be
    enough for the words in common that the similarity asks for, which bounds the sizes that y can have by the place in x. Each bit in which the bits of two sets
    differ is a word that only one has. Two sets with the same word before this one have met there."""
    share = least / (1 + least)

    def search(group: np.ndarray, side: np.ndarray, held: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        ids, n, at, before = held["doc_id"], held["place"] >> 32, held["place"] & 0xFFFFFFFF, held["before"]
        bits = np.stack([held[f"bits{i}"] for i in range(BITS)], axis=1).view(np.uint64)  # of a signed number bitwise_count takes the absolute value
        span = int(n.max()) + 2
        # Groups of two parts have both sides; each looks among the other's rows.
        two = np.zeros(int(group[-1]) + 1, bool)
        two[group[side == 1]] = True
        own = group * 2 + side
        ys = np.flatnonzero(at <= n - np.ceil(2 * share * n - 1e-9) + 1)
        ys = ys[np.argsort(own[ys] * span + n[ys], kind="stable")]
        place = own[ys] * span + n[ys]
        other = np.where(two[group], own ^ 1, own) * span
        most = np.minimum(n, np.floor((n - at + 1) / share - n + 1e-6).astype(np.int64))
        start = np.searchsorted(place, other + np.ceil(least * n - 1e-9).astype(np.int64))
        many = np.maximum(np.searchsorted(place, other + np.maximum(most, 0), "right") - start, 0)
        done, found = np.concatenate([[0], np.cumsum(many)]), []
        # Pairs are numbered, so that those of one row can be cut as well.
        for low in range(0, int(done[-1]), LOOKED):
            pair = np.arange(low, min(low + LOOKED, int(done[-1])))
            a = np.searchsorted(done, pair, "right") - 1
            b = ys[start[a] + pair - done[a]]
            both = np.ceil(share * (n[a] + n[b]) - 1e-9)
            ok = (n[b] - at[b] + 1 >= both) & (n[a] - at[a] + 1 >= both) & ((n[b] < n[a]) | (ids[b] < ids[a]))
            ok &= (before[a] != before[b]) | (at[a] == 1) | (at[b] == 1)
            a, b, both = a[ok], b[ok], both[ok]
            apart = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64)
            ok = n[a] + n[b] - apart >= 2 * both
            found.append((a[ok], b[ok]))
        return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))

    return search


def similar_pairs(sets: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of sets(doc_id, w) with a Jaccard similarity of at least least."""
    return similar_hashed(materialise(sets.where(F.size("w") > 0).select("doc_id", hashed(F.col("w")).alias("h")), "hashed-sets"), least)


def similar_hashed(sets: DataFrame, least: float) -> DataFrame:
    """similar_pairs of sets(doc_id, h), a table of hashed words that is read several times.

    Prefix filtering: a set's words are ordered from rare to frequent, and sets that are this similar share one among the first n - ceil(least * n) + 1 of each;
    so frequent words rarely meet. What meets there is held against sizes, places and bits of both sets before anything is moved for it, and no pair is lost."""
    long = sets.where(F.size("h") > 64 * BITS // 2).limit(1).count() > 0
    # Beginnings of long sets take as much space as the sets, so they are made twice instead of kept.
    rows = beginnings(sets, least) if long else materialise(beginnings(sets, least), "prefixes")
    met = meetings(rows, "gram", ["doc_id", "place", "before", *(f"bits{i}" for i in range(BITS))], near_sets(least))
    pairs = materialise(met.select(F.least("a_doc_id", "b_doc_id").alias("a"), F.greatest("a_doc_id", "b_doc_id").alias("b")).distinct(), "met-sets")
    if long:
        # For long sets the bits are too few, so more of them are held together before the sets are moved.
        pairs = materialise(side_by_side(pairs, prints(sets), bits_apart).where(least / (1 + least) * F.col("total") <= (F.col("total") - F.col("found")) / 2 + 1e-9).select("a", "b"), "near-sets")
    both = F.col("found") / (F.col("total") - F.col("found"))
    return side_by_side(pairs, sets.select("doc_id", F.size("h").alias("n"), "h"), in_common).select("a", "b", both.alias("s")).where(F.col("s") >= least).select("a", "b", F.round("s", 6).alias("similarity"))


def prints(sets: DataFrame) -> DataFrame:
    """(doc_id, n, h): of a set of n words a power of two of bits, above 2 * n, in longs; each says whether an odd number of the words fall on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, n = lists(batch.column(1))
            longs = np.left_shift(1, np.ceil(np.log2(np.maximum(2 * n + 1, 64 * BITS) / 64)).astype(np.int64))
            start = np.cumsum(longs) - longs
            # Bits that two words fall on are taken out, as the words come in pairs.
            at, odd = np.unique(np.repeat(start * 64, n) + (flat & np.repeat(longs * 64 - 1, n)), return_counts=True)
            bits = np.zeros(int(longs.sum()), np.uint64)
            at = at[odd % 2 == 1]
            np.bitwise_or.at(bits, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
            made = pa.ListArray.from_arrays(pa.array(np.concatenate([start, [len(bits)]]), pa.int32()), pa.array(bits.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), made], names=["doc_id", "n", "h"])

    return sets.select("doc_id", "h").mapInArrow(run, "doc_id long, n int, h array<long>")


def side_by_side(pairs: DataFrame, sets: DataFrame, compare: Callable[..., np.ndarray]) -> DataFrame:
    """(a, b, found, total) of pairs(a, b) of sets(doc_id, n, h): what compare(values of all h, their starts, positions of a, positions of b) finds, and the sum of their n.

    Pairs are put in the group of the first set that their a is paired with, so sets that are much alike move to one place once and not for each pair. A group of
    more than COMPARED pairs is cut into parts of its sets, and each two parts are a group of their own."""
    spark = pairs.sparkSession
    heads = pairs.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("head"))
    x = materialise(pairs.join(heads, "a", "left").select("a", "b", F.coalesce("head", "a").alias("head")), "paired-sets")
    many = x.groupBy("head").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > COMPARED).select("head", F.ceil(F.sqrt(F.col("n") / COMPARED)).cast("int").alias("parts"))
    # Such groups are few: one for COMPARED pairs at most. A group's pairs do not come together before they are dealt to its parts.
    x = x.join(F.broadcast(many), "head", "left")
    part = lambda c: F.pmod(F.xxhash64(c), F.coalesce("parts", F.lit(1))).cast("int")
    x = x.select("head", part("a").alias("p"), part("b").alias("q"), "a", "b")
    dealt = ["head", "p", "q"]
    asked = x.select(*dealt, F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    held = asked.join(sets, "doc_id").select(*dealt, F.col("doc_id").alias("a"), F.lit(None).cast("long").alias("b"), "n", "h")
    every = held.unionByName(x.select("*", F.lit(None).cast("int").alias("n"), F.lit(None).cast("array<long>").alias("h")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, dealt):
            yield from _compared(table, group_numbers(table, dealt), compare)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return every.repartition(tasks, *dealt).sortWithinPartitions(*dealt, "b", "a").mapInArrow(run, "a long, b long, found long, total long")


def _compared(table: pa.Table, group: np.ndarray, compare: Callable[..., np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Each group has its sets first, in order of their id, and then its pairs, in order of b."""
    is_set = table["b"].is_null().to_numpy()
    if is_set.all():
        return
    held, pairs = table.filter(pa.array(is_set)), table.filter(pa.array(~is_set))
    flat, size = lists(pa.concat_arrays(held["h"].chunks))
    # A set's place is found by its group and id.
    ids, numbers = np.unique(held["a"].to_numpy(), return_inverse=True)
    place = group[is_set] * len(ids) + numbers
    a, b, n = pairs["a"].to_numpy(), pairs["b"].to_numpy(), held["n"].to_numpy()
    in_a, in_b = (np.searchsorted(place, group[~is_set] * len(ids) + np.searchsorted(ids, c)) for c in (a, b))
    found = compare(flat, np.concatenate([[0], np.cumsum(size)]), in_a, in_b)
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(found, pa.int64()), pa.array(n[in_a] + n[in_b], pa.int64())], names=["a", "b", "found", "total"])


def in_common(flat: np.ndarray, start: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> np.ndarray:
    """How many words two sets have in common; pairs of one b follow each other."""
    # Words are numbered, so that those of one set can be marked.
    words, flat = np.unique(flat, return_inverse=True)
    found, marked = np.zeros(len(in_a), np.int64), np.zeros(len(words), bool)
    ends = np.concatenate([[0], np.flatnonzero(np.diff(in_b)) + 1, [len(in_b)]])
    for low, high in zip(ends[:-1], ends[1:], strict=True):
        own = flat[start[in_b[low]] : start[in_b[low] + 1]]
        marked[own] = True
        for i in range(low, high):
            found[i] = np.count_nonzero(marked[flat[start[in_a[i]] : start[in_a[i] + 1]]])
        marked[own] = False
    return found


def bits_apart(flat: np.ndarray, start: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> np.ndarray:
    """In how many bits two prints differ, which is no more than the words that only one set has. A longer print is folded to as many bits as the shorter has."""
    size, found = np.diff(start), np.zeros(len(in_a), np.int64)
    least = np.minimum(size[in_a], size[in_b])
    for longs in np.unique(least):
        here = np.flatnonzero(least == longs)
        for low in range(0, len(here), max(1, LOOKED * BITS // int(longs))):
            some = here[low : low + max(1, LOOKED * BITS // int(longs))]
            pieces = []
            for at in (in_a[some], in_b[some]):
                made = np.zeros((len(some), int(longs)), np.int64)
                for whole in np.unique(size[at]):
                    which = np.flatnonzero(size[at] == whole)
                    made[which] = np.bitwise_xor.reduce(flat[start[at[which]][:, None] + np.arange(whole)].reshape(len(which), -1, int(longs)), axis=1)
                pieces.append(made)
            found[some] = np.bitwise_count((pieces[0] ^ pieces[1]).view(np.uint64)).sum(axis=1, dtype=np.int64)
    return found


def word_classes(sets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(class, n) of each distinct set of words in sets(doc_id, w), named by its least id, (doc_id, h) of the hashed words of each class, and
    (doc_id, class) of all rows, null if they have no words. A set that many rows share is compared once; sets are told apart by SHA-256."""
    key = F.when(F.size("w") > 0, F.sha2(F.to_json(F.sort_array("w")), 256))
    folded = materialise(sets.select("doc_id", key.alias("key"), hashed(F.col("w")).alias("h")), "word-sets")
    keyed = materialise(folded.select("doc_id", "key"), "word-keys")
    named = materialise(keyed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("class"), F.count(F.lit(1)).alias("n")), "word-classes")
    words = materialise(folded.join(named.select("key", F.col("class").alias("doc_id")), ["key", "doc_id"], "left_semi").select("doc_id", "h"), "class-words")
    discard(folded)
    return named.select("class", "n"), words, keyed.join(named.select("key", "class"), "key", "left").select("doc_id", "class")


def similar_classes(sets: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, similarity) between classes of rows with equal sets of words, and (doc_id, class, n_links): each
    row's class and how many other rows are similar to it. Rows without words are similar to nothing and have none."""
    classes, words, members = word_classes(sets)
    pairs = materialise(similar_hashed(words, least), "similar-pairs")
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(classes.select(F.col("class").alias("b"), "n"), "b").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("others"))
    counted = classes.join(linked, "class", "left").select("class", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    return pairs, members.join(counted, "class").select("doc_id", "class", "n_links")


def greedy_dedup(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id) of the rows that a pass in order of the id keeps: similar to no row kept before, by all words of their texts.

    A row is removed if a kept earlier neighbour exists, so only rows with a similar earlier row are looked
    at: a round settles every row all of whose earlier neighbours are settled, until none is left. Each round is a table
    in the shared folder, so plans do not grow; a round joins the links that are still open alone."""
    # Equal word sets resolve to the least id first, so one set that many rows share makes no pairs.
    classes, words, members = word_classes(docs.select("doc_id", F.array_distinct(X.lower_words(F.coalesce("text", F.lit("")))).alias("w")))
    links = materialise(similar_hashed(words, least).select(F.col("a").alias("before"), F.col("b").alias("doc_id")), "dedup-links")
    removed = []
    while True:
        # Rows that no open link leads to are kept; what they lead to goes, with all links from and to it.
        heads = links.select(F.col("before").alias("doc_id")).distinct().join(links.select("doc_id").distinct(), "doc_id", "left_anti")
        out = materialise(links.join(heads.select(F.col("doc_id").alias("before")), "before", "left_semi").select("doc_id").distinct(), "dedup-out")
        if out.isEmpty():
            break
        removed.append(out)
        left = links.join(out, "doc_id", "left_anti").join(out.select(F.col("doc_id").alias("before")), "before", "left_anti")
        links = materialise(left.select("before", "doc_id"), "dedup-links")
    kept = classes.select(F.col("class").alias("doc_id"))
    if removed:
        gone = removed[0]
        for out in removed[1:]:
            gone = gone.unionByName(out)
        kept = kept.join(gone, "doc_id", "left_anti")
    return kept.unionByName(members.where("class is null").select("doc_id"))


def rank_by_query(rows: DataFrame, query: str, k: int) -> DataFrame:
    """(id, score, rank): .4 * share of query words + .6 * score, k best."""
    asked = F.array_distinct(F.array(*[F.lit(w) for w in query.lower().split()]))
    x = rows.select("id", F.round(0.4 * X.keyword_overlap(asked, X.lower_words(F.col("text"))) + 0.6 * F.col("score"), 6).alias("score"))
    x = x.orderBy(F.desc("score"), "id").limit(k)
    return x.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def relevant_sentences(docs: DataFrame, query: str, least: float = 0.3) -> DataFrame:
    """(doc_id, pos, sentence) where the mean of Jaccard similarity and query coverage is at least least."""
    asked = F.array_distinct(F.array(*[F.lit(w) for w in query.lower().split()]))
    x = docs.select("doc_id", F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("pos", "sentence")).withColumn("w", X.lower_words(F.col("sentence")))
    return x.where((X.jaccard(F.col("w"), asked) + X.keyword_overlap(asked, F.col("w"))) / 2 >= least).select("doc_id", "pos", "sentence")


def key_points(docs: DataFrame, query: str, most: int = 5) -> DataFrame:
    """(doc_id, points): up to two sentences with numbers, then short ones with two query words."""
    asked = F.array(*[F.lit(w) for w in sorted(set(query.lower().split()))])
    s = F.split("text", r"(?<=[.!?])\s+")
    numeric = F.slice(F.filter(s, lambda x: x.rlike("[0-9]")), 1, 2)
    short = F.filter(s, lambda x: (F.length(x) < 200) & (F.size(F.array_intersect(X.lower_words(x), asked)) >= 2))
    return docs.select("doc_id", F.slice(F.array_distinct(F.concat(numeric, short)), 1, most).alias("points"))


def pack_budget(rows: DataFrame, budget: int, group: str, order: str, least: int = 100, margin: int = 50) -> DataFrame:
    """rows(tokens) that fit the budget of their group in order, and the first that does not, truncated, if at
    least `least` tokens are left for it."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = rows.withColumn("upto", F.sum("tokens").over(w))
    left = budget - (F.col("upto") - F.col("tokens"))
    x = x.where((F.col("upto") <= budget) | ((left > 0) & (left >= least)))
    used = F.when(F.col("upto") <= budget, F.col("tokens")).otherwise(left - margin).cast("long")
    return x.select(order, group, "tokens", "upto", used.alias("used"), (F.col("upto") > budget).alias("truncated"))


def styled_context(rows: DataFrame, group: str, order: str, style: str = "numbered", metadata: bool = True) -> DataFrame:
    """(group, context) of rows(source, text, score, tokens) in order: numbered, markdown or simple, with sources, scores
    and a line of totals if metadata are wanted."""
    ordered = F.array_sort(F.collect_list(F.struct(order, "source", "text", "score")))
    score = lambda r: F.format_string("%.2f", F.coalesce(r["score"].cast("double"), F.lit(0.0)))
    source = lambda r: F.coalesce(r["source"], F.lit("Bilinmeyen"))
    text = lambda r: F.concat(F.coalesce(r["text"], F.lit("")), F.lit("\n"))

    def part(r: Column, i: Column) -> Column:
        n = (i + 1).cast("string")
        if style == "numbered":
            about = [F.lit("(Kaynak: "), source(r), F.lit(", Skor: "), score(r), F.lit(")")] if metadata else []
            return F.concat(F.lit("["), n, F.lit("] "), *about, F.lit("\n"), text(r))
        if style == "markdown":
            about = [F.lit("\n*Kaynak: "), source(r), F.lit(" | Skor: "), score(r), F.lit("*\n")] if metadata else []
            return F.concat(F.lit("### Kaynak "), n, *about, F.lit("\n"), text(r))
        return text(r)

    parts = F.transform(ordered, part)
    parts = F.concat(F.array(F.lit("## Ilgili Dokumanlar\n")), parts) if style == "markdown" else parts
    total = F.concat(F.lit("\n---\nToplam: "), F.count(F.lit(1)).cast("string"), F.lit(" dokuman, "), F.coalesce(F.sum("tokens"), F.lit(0)).cast("string"), F.lit(" token"))
    return rows.groupBy(group).agg(F.array_join(F.concat(parts, F.array(total)) if metadata else parts, "\n").alias("context"))


def compress_with(rows: DataFrame, group: str, order: str, query: Column, provider: Provider | None = None, most_words: int = 500, most_chars: int = 2000) -> DataFrame:
    """(group, text): the texts of a group made one by a provider, or, without one, their beginning."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, F.coalesce("text", F.lit("")).alias("text")))), lambda r: r["text"])
    joined = rows.groupBy(group).agg(F.array_join(ordered, "\n\n").alias("joined"), F.array_join(ordered, "\n\n---\n\n").alias("parts"), F.first(query).alias("query"))
    if provider is None:
        return joined.select(group, F.substring("joined", 1, most_chars).alias("text"))
    told = F.concat(F.lit(f"Shorten the passages to what answers the question, with all numbers, in at most {most_words} words.\nQuestion: "), "query", F.lit("\n"), "parts")
    return generate(joined, told, provider).select(group, F.col("answer").alias("text"))


def format_context(rows: DataFrame, group: str, order: str) -> DataFrame:
    """One numbered text a group: [n] source, then the text."""
    ordered = F.array_sort(F.collect_list(F.struct(order, "source", "text")))
    lines = F.transform(ordered, lambda r, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(r["source"], F.lit("")), F.lit("\n"), F.coalesce(r["text"], F.lit(""))))
    return rows.groupBy(group).agg(F.array_join(lines, "\n\n").alias("context"))


def merge_overlaps(chunks: DataFrame, group: str, order: str, tail: int = 100) -> DataFrame:
    """Chunks of a group folded in order: if the last characters of the current one occur in the next one's
    beginning, the next one is appended without as many."""

    def fold(texts: list[str]) -> list[str]:
        made: list[list[str]] = []
        last = ""
        for text in texts:
            if made and last in text[: 2 * tail]:
                made[-1].append(text[tail:])
                last = (last + text[tail:])[-tail:]
            else:
                made.append([text])
                last = text[-tail:]
        return ["".join(parts) for parts in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folded = [fold(texts.as_py()) for texts in batch.column(1)]
            sizes = np.fromiter(map(len, folded), np.int64, len(folded))
            pos = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(folded)), sizes))), pa.array(pos), pa.array([t for texts in folded for t in texts], pa.string())], names=[group, "pos", "text"])

    # A row for each group, so that Python gets many groups at a time.
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda r: r["text"])
    kind = dict(chunks.dtypes)[group]
    return chunks.groupBy(group).agg(ordered.alias("texts")).mapInArrow(run, f"{group} {kind}, pos long, text string")


def batches(rows: Iterator, size: int) -> Iterator[list]:
    """Lists of up to size items."""
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held

"""Audit of how the sources of a language differ in their words.

Terms are found on bytes: the texts of a batch lie in one UTF-8 buffer, a numpy table tells which bytes are letters
(A to Z, a to z, and all bytes of characters beyond ASCII) and another lowers A to Z; where the class changes, and at the
borders of texts, terms begin and end. Terms are grouped by their XXH64; every slice is then compared byte by byte
with the first of its group, and those that differ are grouped anew among themselves, so a collision joins nothing.

A language keeps the terms that stand in at least LEAST_DOCS of its documents. A group (language, source) gives each of
the V kept terms p = 1 + floor(SCALE * (count + 2) / (N + 2 * V)), N being the group's occurrences of kept terms, and so does
the language; f(p, q) = floor((p - q)^2 / (p + q)) says how far two of them lie apart.

The kept counts are dealt out by language and a hash of the term into blocks. In a block they are a CSR matrix of sources
by terms: one source at a time is spread out, all entries of the further sources are compared with it at once,
and reduceat adds them up by source. Terms that neither or only one of two sources has are added from the sums
of rows, so the work is in proportion to the entries times the sources, not to terms times pairs of sources. Sums of blocks are added
up by Spark. All numbers are integers, so no order of adding changes a result.

Scale: a task sends one row for each term and source of about BATCH bytes of text. No language or source is gathered in
one task: the number of a language's blocks grows with its entries. The rows of one term are at most the sources of its
language. The pairs of sources of a language are all returned, as asked, and are the only thing here that grows with a square.

Defined results: null texts, languages and sources are empty strings; a group without terms takes part with
counts of 0. A language that keeps no term has value 0 for all pairs and no terms. Repeated rows are documents of
their own. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veldspar.llm._shared import materialise

#: Documents of a language that a term must stand in.
LEAST_DOCS = 10
SCALE = 1_000_000_000
#: Terms that are listed for a group.
TERMS = 10
#: Bytes of text that are counted at once; a longer text is counted by itself.
BATCH = 8 << 20
#: Entries of a block: at least so many, more if a language has so many sources that their pairs would outnumber them, at most MOST.
ENTRIES, MOST = 1 << 15, 1 << 22

_BYTES = np.arange(256)
_LETTER = (_BYTES >= 128) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122))
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and where each begins, with the end; nulls are empty."""
    texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the terms of texts begin and end; at: where texts begin, with the end."""
    inside = _LETTER[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = np.flatnonzero(at[1:] > at[:-1])
    first, last = at[:-1][full], at[1:][full] - 1
    begins[first], ends[last] = inside[first], inside[last]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def grouped(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each slice, equal for equal bytes alone, and the first slice of each number."""
    numbers, firsts = np.zeros(len(begins), np.int64), []
    sizes, left, so_far = ends - begins, np.arange(len(begins)), 0
    while len(left):
        codes, values = pd.factorize(hashes[left])
        first = np.zeros(len(values), np.int64)
        first[codes[::-1]] = left[::-1]
        like = first[codes]
        same = sizes[left] == sizes[like]
        own, other = left[same], like[same]
        grown = np.cumsum(sizes[own])
        within = np.arange(grown[-1] if len(grown) else 0) - np.repeat(grown - sizes[own], sizes[own])
        differ = data[np.repeat(begins[own], sizes[own]) + within] != data[np.repeat(begins[other], sizes[own]) + within]
        if len(own):
            same[np.flatnonzero(same)[np.logical_or.reduceat(differ, grown - sizes[own])]] = False
        numbers[left[same]] = so_far + codes[same]
        firsts.append(first)
        so_far += len(values)
        left = left[~same]
    return numbers, np.concatenate(firsts) if firsts else np.zeros(0, np.int64)


def counted(texts: pa.Array, groups: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms, and by group and term that occur: the group, the term's place, occurrences and documents."""
    data, at = buffers(texts)
    begins, ends = slices(data, at)
    data = _LOWER[data]
    raw, of = data.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((of(raw[b:e]) for b, e in zip(begins.tolist(), ends.tolist(), strict=True)), np.uint64, len(begins))
    numbers, firsts = grouped(data, begins, ends, hashes)
    n = max(1, len(firsts))
    docs = np.searchsorted(at, begins, side="right") - 1
    held, times = np.unique(docs * n + numbers, return_counts=True)
    keys, where = np.unique(groups[held // n] * n + held % n, return_inverse=True)
    sums = np.bincount(where, times, len(keys)).astype(np.int64)
    return [raw[begins[i] : ends[i]].decode() for i in firsts.tolist()], keys // n, keys % n, sums, np.bincount(where, minlength=len(keys))


def _parts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that have about `most` bytes together."""
    at = 0
    grown = np.cumsum(sizes)
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(grown, (grown[at - 1] if at else 0) + most, side="right")))
        yield at, end
        at = end


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", batch: int = BATCH) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, added up; term null once for each group that occurs."""
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            for at, end in _parts(np.diff(buffers(given.column(0))[1]), batch):
                part = given.slice(at, end - at)
                keys = pd.MultiIndex.from_arrays([part.column(1).to_pandas(), part.column(2).to_pandas()])
                groups, names = pd.factorize(keys)
                terms, group, term, n, held = counted(part.column(0), groups)
                every = np.concatenate((np.arange(len(names)), group))
                take = lambda level, every=every, names=names: pa.array(names.get_level_values(level).to_numpy(object), pa.string()).take(pa.array(every))
                zeros = np.zeros(len(names), np.int64)
                named = pa.concat_arrays([pa.nulls(len(names), pa.string()), pa.array(terms, pa.string()).take(pa.array(term))])
                yield pa.record_batch({"lang": take(0), "source": take(1), "term": named, "n": np.concatenate((zeros, n)), "docs": np.concatenate((zeros, held))})

    found = docs.select(text(text_col), text(lang_col), text(source_col)).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def scaled(part: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * part / whole) without overflow, for parts up to the whole."""
    if np.any(np.asarray(whole) > (1 << 63) // 1000):
        raise ValueError("more occurrences than 64 bits hold in thousandths")
    out, left = np.zeros_like(part), part
    for _ in range(3):
        out = out * 1000 + left * 1000 // whole
        left = left * 1000 % whole
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q))."""
    return (p - q) ** 2 // (p + q)


def _by_row(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of the rows of a CSR matrix, 0 for rows without entries."""
    out = np.zeros(len(sizes), np.int64)
    full = np.flatnonzero(sizes)
    if len(full):
        out[full] = np.add.reduceat(values, begins[full], dtype=np.int64)
    return out


def divergences(rows: np.ndarray, columns: np.ndarray, p: np.ndarray, p0: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of a matrix in order of rows (entries p, elsewhere p0 of the row), its sums of f with each later row, over
    its width columns."""
    n = len(p0)
    sizes = np.bincount(rows, minlength=n)
    begins = np.cumsum(sizes) - sizes
    for i in range(n - 1):
        own = slice(begins[i], begins[i] + sizes[i])
        spread, has = np.full(width, p0[i]), np.zeros(width, bool)
        spread[columns[own]], has[columns[own]] = p[own], True
        rest = slice(begins[i] + sizes[i], len(p))
        starts, here = begins[i + 1 :] - rest.start, columns[rest]
        mine, both, zero = spread[here], has[here], np.repeat(p0[i + 1 :], sizes[i + 1 :])
        out = _by_row(apart(mine, p[rest]) - np.where(both, apart(mine, zero), 0), starts, sizes[i + 1 :])
        values, times = np.unique(p[own], return_counts=True)
        for at in range(0, len(values), 256):
            some = slice(at, at + 256)
            out += (times[some, None] * apart(values[some, None], p0[None, i + 1 :])).sum(axis=0)
        union = sizes[i] + sizes[i + 1 :] - _by_row(both, starts, sizes[i + 1 :])
        yield i, out + (width - union) * apart(p0[i], p0[i + 1 :])


def _block(key: tuple, cells: pa.Table, totals: pa.Table) -> pa.Table:
    """The sums of a block: pairs of sources (the first in order as source, the other as item) and each source's foremost terms."""
    lang, block = key[0].as_py(), key[1].as_py()
    names = np.array(totals["source"].to_pylist(), object)
    order = np.argsort(names)
    names, words = names[order], totals["words"].to_numpy()[order]
    kept, all_words = int(totals["kept"][0].as_py()), int(totals["lang_words"][0].as_py())
    place = {s: i for i, s in enumerate(names)}
    rows = np.array([place[s] for s in cells["source"].to_pylist()], np.int64)
    columns, terms = pd.factorize(cells["term"].to_numpy(zero_copy_only=False))
    by = np.lexsort((columns, rows))
    rows, columns = rows[by], columns[by]
    n, n_all = (cells[c].to_numpy()[by] for c in ("n", "n_all"))
    source, item, part, value = [], [], [], []
    if kept:
        p0 = scaled(np.full(len(names), 2), words + 2 * kept)
        p = scaled(n + 2, words[rows] + 2 * kept)
        sums = divergences(rows, columns, p, p0, len(terms))
    else:
        sums = ((i, np.zeros(len(names) - 1 - i, np.int64)) for i in range(len(names) - 1))
    for i, out in sums:
        some = np.arange(len(out)) if not block else np.flatnonzero(out)
        source.append(np.full(len(some), i))
        item += names[i + 1 + some].tolist()
        value.append(out[some])
    part += ["pair"] * len(item)
    if kept and len(rows):
        q = scaled(n_all + 2, all_words + 2 * kept)
        f, more = apart(p, q), p > q
        nth = np.argsort(np.argsort(np.array([t.encode() for t in terms], object)))
        best = np.lexsort((nth[columns], -f, rows))
        best = best[more[best]]
        first = np.concatenate(([True], rows[best][1:] != rows[best][:-1])) if len(best) else np.zeros(0, bool)
        best = best[np.arange(len(best)) - np.maximum.accumulate(np.where(first, np.arange(len(best)), 0)) < TERMS]
        source.append(rows[best])
        item += terms[columns[best]].tolist()
        value.append(f[best])
        part += ["term"] * len(best)
    said = names[np.concatenate(source)] if source else []
    return pa.table({"lang": pa.array([lang] * len(item), pa.string()), "source": pa.array(said, pa.string()), "part": pa.array(part, pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(np.concatenate(value) if value else [], pa.int64())})


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, entries: int = ENTRIES) -> DataFrame:
    """(lang, source, part, item, value, rank): how far every other source of the language lies from a source (part pair), and its
    foremost terms against its language (part term)."""
    cells = materialise(term_counts(docs, text_col, lang_col, source_col), "divergence-counts")
    groups = cells.where("term is null").select("lang", "source")
    of_term = Window.partitionBy("lang", "term")
    kept = cells.where("term is not null").withColumns({"in_docs": F.sum("docs").over(of_term), "n_all": F.sum("n").over(of_term), "first": F.min("source").over(of_term) == F.col("source")})
    kept = materialise(kept.where(F.col("in_docs") >= least_docs).select("lang", "source", "term", "n", "n_all", "first"), "divergence-kept")
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_words"), F.count_if("first").alias("kept"), F.count(F.lit(1)).alias("entries"))
    size = F.least(F.lit(MOST), F.greatest(F.lit(entries), 2 * F.col("sources") * F.col("sources")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(of_lang, "lang", "left")
    langs = materialise(langs.select("lang", zero("lang_words"), zero("kept"), F.greatest(F.lit(1), F.ceil(zero("entries") / size)).cast("int").alias("blocks")), "divergence-langs")
    totals = groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("words")), ["lang", "source"], "left").join(langs, "lang")
    totals = totals.select("lang", "source", zero("words"), "lang_words", "kept", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    dealt = kept.join(langs.select("lang", "blocks"), "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    dealt = dealt.select("lang", "block", "source", "term", "n", "n_all")
    found = dealt.groupBy("lang", "block").cogroup(totals.groupBy("lang", "block")).applyInArrow(_block, "lang string, source string, part string, item string, value long")
    found = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    end = lambda one, other: F.struct(F.col(one).alias("source"), F.col(other).alias("item"))
    both = F.when(F.col("part") == "pair", F.array(end("source", "item"), end("item", "source"))).otherwise(F.array(end("source", "item")))
    found = found.select("lang", "part", "value", F.inline(both))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return found.select("lang", "source", "part", "item", "value", rank.alias("rank")).where((F.col("part") == "pair") | (F.col("rank") <= TERMS))

"""Language identification by nearest clustered centroid.

A text becomes a vector of hashed character n-grams (1 to 3 characters of each word, padded by one
space), weighted 1 + ln(count) times inverse document frequency and scaled to unit length. Each
language owns several centroids, found by spherical k-means over a bounded sample of labelled rows.
A text takes the language of the centroid of largest cosine, and is rejected when its distance from
that centroid is above the limit of the language.

The sample is at most SAMPLE_PER_LANGUAGE rows a language. Document frequencies are added up in Spark, and
each language is clustered in a task of its own. Three rows in four make the centroids; the others, which
the centroids have not seen, tell how far texts of the language lie from them and so set the limit.

Each text is counted by itself, padded on both sides, and its cosines are sums over its own n-grams alone, so
a prediction does not depend on the rows beside it, their order or how they are partitioned.

Defined results: null texts and texts without a letter get `und`, score 0, rejected. Ties between
centroids go to the language first in code point order. Repeated rows are predicted one by one.
Labelled rows without a letter or with a null language are not learned from. With nothing to learn
from, every text is `und`. A table without rows gives none. Extra columns are kept, and columns of docs named
like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from veldspar.llm._shared import carried, materialise

#: Hash buckets of the n-gram space.
DIMS = 1 << 13
#: Labelled rows that the centroids and document frequencies of one language are learned from, at most.
SAMPLE_PER_LANGUAGE = 400
CENTROIDS = 4
ITERATIONS = 12
#: Characters that are turned into features at a time.
PIECE = 1 << 19
#: Products that are held at a time.
HELD = 1 << 22
#: One row in so many of the sample is kept from the centroids and measured against them.
MEASURED = 4
#: A text is rejected if its cosine is below this share of a low percentile of the measured rows' cosines, so that
#: no single odd row sets the limit.
REJECT_SHARE = 0.5
REJECT_PERCENTILE = 1
#: Texts of fewer n-grams (about five words) lie far from any centroid; they are held to a part of the limit.
SHORT = 100
SHORT_SHARE = 0.5

_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Code point to its lower-case letter, or to a space for anything else."""
    global _LETTERS
    if _LETTERS is None:
        table = np.full(0x110000, 32, np.uint32)
        for cp in range(0x110000):
            if (c := chr(cp)).isalpha():
                table[cp] = ord(c.lower()[0])
        _LETTERS = table
    return _LETTERS


def _pieces(text: str) -> Iterator[str]:
    """Cut a long text at white space, so that no word is split unless one word is longer than PIECE."""
    at = 0
    while len(text) - at > PIECE:
        cut = max(text.rfind(" ", at, at + PIECE), text.rfind("\n", at, at + PIECE))
        cut = cut if cut > at else at + PIECE
        yield text[at:cut]
        at = cut
    yield text[at:]


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed n-grams of texts, and the number of the text that each belongs to."""
    sizes = np.array([len(t) + 2 for t in texts])
    c = _letters()[np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    of = np.repeat(np.arange(len(texts)), sizes)
    # Of spaces in a row within a text the first stays.
    stays = np.flatnonzero(~((c == 32) & np.concatenate(([False], (c[:-1] == 32) & (of[1:] == of[:-1])))))
    c, of = c[stays].astype(np.uint64), of[stays]
    a, b, d = c[:-2], c[1:-1], c[2:]
    two, three = a * np.uint64(0x10001) + b, (a * np.uint64(0x10001) + b) * np.uint64(0x9E3779B1) + d + np.uint64(1 << 60)
    # Every text begins and ends with a space, so a gram lies within one text unless two of its spaces meet.
    one, pair, triple = c != 32, (c[:-1] != 32) | (c[1:] != 32), b != 32
    last = c[-2:-1] * np.uint64(0x10001) + c[-1:]
    h = np.concatenate((c[one], np.concatenate((two, last))[pair] + np.uint64(1 << 58), three[triple]))
    h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 13)
    return h.astype(np.int64), np.concatenate((of[one], of[:-1][pair], of[1:-1][triple]))


def count_grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, count) of all n-grams of whole texts, in order of text and bucket."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    group: list[tuple[int, str]] = []
    chars, cut = 0, False

    def flush() -> None:
        nonlocal group, chars
        if group:
            h, of = _grams([t for _, t in group])
            n = np.bincount(of * DIMS + h, minlength=len(group) * DIMS)
            at = np.flatnonzero(n)
            found.append((np.array([k for k, _ in group])[at // DIMS], at % DIMS, n[at]))
        group, chars = [], 0

    for k, text in enumerate(texts):
        for nth, piece in enumerate(_pieces(text or "")):
            cut |= nth > 0
            if piece:
                group.append((k, piece))
                chars += len(piece)
            if chars >= PIECE or len(group) >= 64:
                flush()
    flush()
    if not found:
        return (np.zeros(0, np.int64),) * 3
    text, bucket, n = (np.concatenate(x) for x in zip(*found, strict=True))
    if cut:  # the pieces of one text are added up
        both, place = np.unique(text * DIMS + bucket, return_inverse=True)
        text, bucket, n = both // DIMS, both % DIMS, np.bincount(place, n).astype(np.int64)
    return text, bucket, n


def weigh(text: np.ndarray, bucket: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights of counts, scaled so that those of each text have length one."""
    if not len(text):
        return np.zeros(0)
    w = (1 + np.log(n)) * idf[bucket]
    begins = np.flatnonzero(np.diff(text, prepend=-1))
    return w / np.repeat(np.sqrt(np.add.reduceat(w * w, begins)), np.diff(begins, append=len(w)))


@dataclass
class Centroids:
    """A fitted classifier: the idf weights, unit centroids (a column each), their languages and cosine limits."""

    idf: np.ndarray
    vectors: np.ndarray
    languages: list[str]
    limits: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores in 0 to 1, and whether the distance limit rejects."""
        langs, scores, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        text, bucket, n = count_grams(texts)
        if not self.languages or not len(text):
            return langs, scores, rejected
        begins = np.flatnonzero(np.diff(text, prepend=-1))
        w = weigh(text, bucket, n, self.idf)
        # A few texts at a time, so that memory does not follow the number of languages.
        first = np.flatnonzero(np.diff(begins // max(1, HELD // len(self.languages)), prepend=-1))
        parts = zip(first, [*first[1:], len(begins)], begins[first], [*begins[first[1:]], len(text)], strict=True)
        cosine = np.concatenate([np.add.reduceat(self.vectors[bucket[i:j]] * w[i:j, None], begins[b:e] - i, axis=0) for b, e, i, j in parts])
        best = cosine.argmax(axis=1)
        top = cosine[np.arange(len(best)), best]
        limit = self.limits[best] * np.where(np.add.reduceat(n, begins) < SHORT, SHORT_SHARE, 1.0)
        for k, b in zip(text[begins], best, strict=True):
            langs[k] = self.languages[b]
        scores[text[begins]], rejected[text[begins]] = top.clip(0, 1), top < limit
        return langs, scores, rejected


def cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means with farthest-first starts: unit centroids, at most k."""
    mean = x.mean(axis=0)
    start = [int(np.argmax(x @ mean))]
    near = x @ x[start[0]]
    while len(start) < min(k, len(x)):
        far = int(np.argmin(near))
        if near[far] > 1 - 1e-6:
            break
        start.append(far)
        near = np.maximum(near, x @ x[far])
    c = x[start].copy()
    for _ in range(ITERATIONS):
        owner = (x @ c.T).argmax(axis=1)
        new = np.stack([x[owner == j].sum(axis=0) if (owner == j).any() else c[j] for j in range(len(c))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, c, atol=1e-6):
            break
        c = new
    return c


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE, centroids: int = CENTROIDS) -> Centroids:
    """Learn from at most per_language rows of each language, those of smallest key hash. The counts of
    rows by language, which set the share to read, are taken over all labelled rows. To the driver come the
    document frequencies of DIMS buckets and the centroids, whatever the number of rows."""
    rows = labelled.select(F.col(key_col).alias("key"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null")
    order = F.xxhash64(F.col("key"))
    sizes = rows.groupBy("lang").count()
    # Written first, so that its size is known and the texts are filtered where they are read.
    share = F.least(F.lit(1.0), F.lit(1.5 * per_language + 50) / F.col("count"))
    part = (order.bitwiseAND((1 << 31) - 1) / float(1 << 31)) < F.col("share")
    shares = materialise(sizes.select("lang", share.alias("share")), "language-shares")
    sample = rows.join(shares, "lang").where(part & F.col("text").isNotNull())
    first = Window.partitionBy("lang").orderBy(order, "key", "text")
    sample = sample.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= per_language).select("lang", "nth", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, bucket, n = count_grams(batch["text"].to_pylist())
            begins = np.flatnonzero(np.diff(text, prepend=-1))
            ends = np.append(begins[1:], len(text)).astype(np.int64)
            blobs = lambda x, kind: pa.array([x[b:e].astype(kind).tobytes() for b, e in zip(begins, ends, strict=True)], pa.binary())  # noqa: E731, B023
            yield pa.record_batch({"lang": batch["lang"].take(pa.array(text[begins])), "nth": batch["nth"].take(pa.array(text[begins])), "at": blobs(bucket, "<u2"), "n": blobs(n, "<f4")})

    found = materialise(sample.mapInArrow(features, "lang string, nth int, at binary, n binary"), "language-sample")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for at in batch["at"].to_pylist():
                df[np.frombuffer(at, "<u2")] += 1
                rows += 1
        held = np.append(np.flatnonzero(df), DIMS)  # the number of rows stands beyond the buckets
        yield pa.record_batch({"bucket": pa.array(held, pa.int64()), "df": pa.array(np.append(df, rows)[held], pa.int64())})

    df = np.zeros(DIMS + 1, np.int64)
    for r in found.select("at").mapInArrow(frequencies, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect():
        df[r.bucket] = r.df
    idf = np.log((1 + df[DIMS]) / (1 + df[:DIMS])) + 1

    def language(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("nth")
        x = np.zeros((rows.num_rows, DIMS))
        for k, (at, n) in enumerate(zip(rows["at"].to_pylist(), rows["n"].to_pylist(), strict=True)):
            at, n = np.frombuffer(at, "<u2").astype(np.int64), np.frombuffer(n, "<f4").astype(float)
            x[k, at] = weigh(np.zeros(len(at), np.int64), at, n, idf)
        measured = np.arange(len(x)) % MEASURED == MEASURED - 1
        c = cluster(x[~measured], centroids)
        near = (x[measured] if measured.any() else x) @ c.T
        limit = REJECT_SHARE * float(np.percentile(near.max(axis=1), REJECT_PERCENTILE))
        return pa.table({"lang": pa.array([rows["lang"][0].as_py()] * len(c)), "limit": pa.array([limit] * len(c)), "centroid": pa.array([v.astype("<f4").tobytes() for v in c], pa.binary())})

    made = found.groupBy("lang").applyInArrow(language, "lang string, limit double, centroid binary").toPandas()
    made = made.sort_values("lang", kind="stable")
    vectors = np.stack([np.frombuffer(v, "<f4") for v in made["centroid"]], axis=1) if len(made) else np.zeros((DIMS, 0), np.float32)
    return Centroids(idf, np.ascontiguousarray(vectors.astype(float)), made["lang"].tolist(), made["limit"].to_numpy())


def identify(docs: DataFrame, model: Centroids, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with lang_pred, lang_score and lang_rejected; keep names the columns to carry (all if None).
    Columns of docs by those names are replaced."""
    new = {"lang_pred": T.StringType(), "lang_score": T.DoubleType(), "lang_rejected": T.BooleanType()}
    kept = carried(docs, keep, new)
    # A text that is carried along goes to Python once.
    place = kept.index(text_col) if text_col in kept else len(kept)
    source = docs.select(*kept) if place < len(kept) else docs.select(*kept, F.col(text_col).alias("__text"))
    schema = T.StructType([*(f for f in docs.select(*kept).schema.fields), *(T.StructField(n, t) for n, t in new.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                lang, score, rejected = model.predict(part.column(place).to_pylist())
                columns = [*part.columns[: len(kept)], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *new])

    return source.mapInArrow(run, schema)


def learned_rows(docs: DataFrame, doc_id: Column) -> DataFrame:
    """Rows that op1 may learn from: crc32 of the id as text, modulo 3, is not 1 (null ids count)."""
    return docs.where(F.coalesce(F.crc32(doc_id.cast("string")) % 3, F.lit(0)) != 1)

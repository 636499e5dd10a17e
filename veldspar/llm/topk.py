"""Exact top-k by inner product, term at a time.

Candidates are stored as postings: for each dimension the candidates with a weight in it, and the weights.
Queries are sparse rows of (dimension, weight). Term at a time, a dimension's weighted postings are scattered
into dense arrays of scores, one slot a candidate, of the queries that have the term: GROUP of them at once,
side by side, so that one walk over a list serves all, and SLICE candidates at a time, so that their scores stay
in a core's cache. Scores are as narrow as the largest possible one allows. The k best are selected in each
partition of candidates and merged over partitions.

Candidates are packed into blocks of at most BLOCK rows and queries into blocks of at most QUERIES, so a
task holds one of each; every query block meets every candidate block through a join on block numbers.

Defined results: vectors that are null, or hold a null or non-finite component, take no part; nor do rows
with a null id. Vectors of different lengths count as zero beyond their end. Ties go to the smaller id. A
query's own row is every row of its id; of repeated query ids the vector first in order asks. Components
are floor(scale * x) and scores 64-bit integers: sums that may not fit are taken in integers of any size, and the query fails if a
component or a score does not fit, as no other result would be right. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veldspar.llm._shared import materialise

SCALE = 256
BLOCK = 16384
QUERIES = 1024
#: Queries whose scores are added up side by side, and candidates that they are added up for at a time.
GROUP, SLICE = 64, 1024
#: Tasks that blocks of candidates are dealt to, at most: a layout, results are the same for any number.
TASKS = 20_000


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, v, asks): integer components of the rows that take part."""
    part = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"), F.coalesce(F.col("__asks"), F.lit(False)).alias("asks"))
    part = part.where(F.col("id").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    large = F.raise_error(F.lit("a component does not fit in 64 bits")).cast("long")
    whole = lambda x: F.when(F.abs(F.lit(float(scale)) * x) < float(1 << 63), F.floor(F.lit(float(scale)) * x).cast("long")).otherwise(large)
    return part.select("id", F.transform("x", whole).alias("v"), "asks")


def _packed(rows: DataFrame, size: int, name: str) -> DataFrame:
    """(block, ids, lengths, data): the rows in blocks of about size, by a hash; values as narrow as they fit."""
    n = rows.count()
    blocks = max(1, -(-n // size))
    salted = rows.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        v = table["v"].combine_chunks()
        lengths = np.array(v.value_lengths().to_numpy(zero_copy_only=False), "<i4")
        values = v.flatten().to_numpy(zero_copy_only=False)
        most = _largest(values) if len(values) else 0
        values = values.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8")
        ids = table["id"].to_numpy().astype("<i8")
        return pa.table({"block": table["block"][:1], "ids": pa.array([ids.tobytes()], pa.binary()), "lengths": pa.array([lengths.tobytes()], pa.binary()), "data": pa.array([values.tobytes()], pa.binary())})

    return materialise(salted.groupBy("block").applyInArrow(pack, "block int, ids binary, lengths binary, data binary"), name)


def _unpacked(ids: bytes, lengths: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids and a dense matrix of a block, in order of the id."""
    key, n = np.frombuffer(ids, "<i8"), np.frombuffer(lengths, "<i4")
    v = np.frombuffer(data, f"<i{len(data) // max(1, int(n.sum()))}" if data else "<i8")
    out = np.zeros((len(key), int(n.max(initial=0))), np.int64)
    row = np.repeat(np.arange(len(key)), n)
    out[row, np.arange(len(v)) - np.repeat(np.cumsum(n) - n, n)] = v
    order = np.argsort(key, kind="stable")
    return key[order], out[order]


def postings(matrix: np.ndarray) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """For each slice of candidates and each dimension the candidates that have a weight in it, and their weights."""
    out = []
    for at in range(0, len(matrix), SLICE):
        columns = np.ascontiguousarray(matrix[at : at + SLICE].T)
        held = [np.flatnonzero(c) for c in columns]
        out.append([(h, c[h]) for h, c in zip(held, columns, strict=True)])
    return out


def accumulate(n: int, lists: list[list[tuple[np.ndarray, np.ndarray]]], queries: np.ndarray) -> np.ndarray:
    """Scores of n candidates for a few queries, a row each, term by term over their non-zero weights."""
    out = np.zeros((len(queries), n), np.int64)
    for at, part in zip(range(0, n, SLICE), lists, strict=True):
        terms = [d for d in np.flatnonzero(queries[:, : len(part)].any(axis=0)) if len(part[d][0])]
        most = sum(_largest(part[d][1]) * _largest(queries[:, d]) for d in terms)
        kind = np.int32 if most < 1 << 31 else np.int64 if most < 1 << 63 else object
        scores = np.zeros((min(SLICE, n - at), len(queries)), kind)
        for d in terms:
            held, weights = part[d]
            asking = np.flatnonzero(queries[:, d])
            if len(asking) == len(queries):
                scores[held] += weights.astype(kind)[:, None] * queries[:, d].astype(kind)
            else:
                scores[held[:, None], asking] += weights.astype(kind)[:, None] * queries[asking, d].astype(kind)
        if kind is object:
            out = out.astype(object)
        out[:, at : at + SLICE] = scores.T
    return out


def _largest(x: np.ndarray) -> int:
    """The largest absolute value, as an integer of any size."""
    return max(abs(int(x.min())), abs(int(x.max())))


def select(ids: np.ndarray, scores: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best candidates of a block (ids ascending) for one query: ids and scores, ties to smaller ids."""
    own = slice(int(np.searchsorted(ids, query_id)), int(np.searchsorted(ids, query_id, side="right")))
    if own.stop > own.start:
        ids, scores = np.delete(ids, own), np.delete(scores, own)
    if len(ids) > k:
        least = np.partition(scores, len(ids) - k)[len(ids) - k]
        above, level = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
        best = np.concatenate((above, level[: k - len(above)]))
    else:
        best = np.arange(len(ids))
    if scores.dtype == object and any(not -(1 << 63) <= x < 1 << 63 for x in scores[best]):
        raise OverflowError("a score does not fit in 64 bits")
    return ids[best], scores[best].astype(np.int64)


def search_block(ids: np.ndarray, lists: list[list[tuple[np.ndarray, np.ndarray]]], query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores) of the k best of a block of candidates for each of a block of queries."""
    out = []
    for at in range(0, len(query_ids), GROUP):
        rows = accumulate(len(ids), lists, queries[at : at + GROUP])
        out += [(int(q), *select(ids, row, int(q), k)) for q, row in zip(query_ids[at : at + GROUP], rows, strict=True)]
    return out


def top_k(vectors: DataFrame, asks: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, id, score) of the k best rows for each row where asks holds."""
    rows = materialise(quantised(vectors.withColumn("__asks", asks), id_col, vector_col, scale), "topk-rows")
    asked = rows.where("asks").groupBy("id").agg(F.min("v").alias("v"))
    rows = rows.select("id", "v")
    # Each block of candidates is a task of its own; by their bytes, many would be read by one.
    found = _packed(rows, BLOCK, "topk-candidates")
    found = found.repartition(max(1, min(found.count(), TASKS)))
    queries = _packed(asked, QUERIES, "topk-queries")
    numbers = found.agg(F.max("block")).first()[0]
    if numbers is None:
        numbers = -1
    spread = queries.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(int(numbers))) if numbers >= 0 else F.array().cast("array<int>")))
    spread = spread.select("to", *(F.col(c).alias(f"q_{c}") for c in ("ids", "lengths", "data")))
    met = found.join(spread, F.col("block") == F.col("to")).select("ids", "lengths", "data", "q_ids", "q_lengths", "q_data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, np.ndarray, list] | None = None
        for batch in batches:
            for r in batch.to_pylist():
                if last is None or last[0] != r["ids"]:
                    ids, matrix = _unpacked(r["ids"], r["lengths"], r["data"])
                    last = (r["ids"], ids, postings(matrix))
                out = search_block(last[1], last[2], *_unpacked(r["q_ids"], r["q_lengths"], r["q_data"]), k)
                yield pa.record_batch({"query_id": pa.array(np.repeat([q for q, _, _ in out], [len(x) for _, x, _ in out]).astype(np.int64)), "vec_id": pa.array(np.concatenate([x for _, x, _ in out]) if out else np.zeros(0, np.int64)), "score": pa.array(np.concatenate([s for _, _, s in out]) if out else np.zeros(0, np.int64))})

    best = met.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

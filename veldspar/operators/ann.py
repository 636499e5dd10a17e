"""An inverted-file vector index in tables: coarse centroids, lists of vectors by their nearest centroid, and probes of some lists.

Centroids are fitted on a bounded sample (SAMPLE rows at most, those of the smallest hashes of their ids) and are at most CELLS, so
their matrix has a proven size and is the only thing that every task holds. Every vector is put into the list of its nearest
centroid, in one pass without a shuffle, and the lists are written in order of their cells, so that a cell is a run of row groups.
A query asks the lists of its nearest centroids. Lists and queries meet by cell; a cell of many vectors or many queries is
dealt to several tasks, in each of which the k best of every query are found by products of matrices, and Spark merges them.

Probing all cells is an exact search. Defined results: vectors that are null, empty, or hold null or non-finite components take no part;
those of length zero are similar to nothing (0) and are in the list of the first cell. Ties go to smaller ids. An empty table
makes an index that finds nothing. Adding rows appends to the lists; the centroids stay as they were fitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.operators.retrieval import best
from veldspar.operators.scratch import materialise, scratch_path

#: Most rows that centroids are fitted on, and rows for each centroid.
SAMPLE, EACH = 65_536, 32
#: Most centroids; up to there the square root of the number of vectors.
CELLS = 4096
ROUNDS = 10
#: Share of the cells that a query asks, unless told otherwise: what vectors that hardly cluster need for a recall of 0.9 and more (0.25 of the
#: cells gave 0.67 on the given tables, 0.5 gave 0.83 and 0.90, 0.7 gave 0.97 and 0.96); clustered ones want far less.
PROBED = 0.7
#: Vectors and queries of a cell that meet in one task.
VECTORS, ASKS = 16_384, 2048


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors that take part."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("id").isNotNull() & (F.size("v") > 0) & ~odd)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit vectors, zero where a vector is."""
    rows = column.to_pylist()
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for row, v in zip(out, rows, strict=True):
        row[: len(v)] = v
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=np.zeros_like(out), where=size > 0)


def _fitting(m: np.ndarray, width: int) -> np.ndarray:
    return m[:, :width] if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def fit(sample: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means of unit vectors: spread starts (each next one from the rows far from those before), then rounds of
    assigning and averaging. Empty cells keep their centroid."""
    r = np.random.default_rng(7)
    centroids = [sample[0]]
    near = sample @ sample[0]
    while len(centroids) < min(cells, len(sample)):
        far = np.maximum(1 - near, 0) ** 2
        if far.sum() < 1e-9:
            break
        pick = sample[r.choice(len(sample), p=far / far.sum())]
        centroids.append(pick)
        near = np.maximum(near, sample @ pick)
    c = np.stack(centroids)
    for _ in range(ROUNDS):
        own = (sample @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.where(size > 0, size, 1), c)
    return c


class VectorIndex:
    """Tables `centroids` (cell, v) and `lists` (cell, id, v) in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        held = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
        self.centroids = np.array([r.v for r in held]) if held else np.zeros((0, 0))
        self.lists = spark.read.parquet(f"{path}/lists")

    @classmethod
    def build(cls, vectors: DataFrame, path: str | None = None, id_col: str = "id", vector_col: str = "embedding", cells: int | None = None) -> VectorIndex:
        spark = vectors.sparkSession
        path = path or scratch_path(spark, "vector-index")
        rows = usable(vectors, id_col, vector_col)
        n = rows.count()
        cells = min(cells or max(1, round(n**0.5)), CELLS)
        sample = rows.orderBy(F.xxhash64("id"), "id").limit(min(SAMPLE, EACH * cells)).select("v").toArrow()["v"]
        m = _matrix(sample)
        found = fit(m, cells) if len(m) else np.zeros((0, 0))
        spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(found)], "cell int, v array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
        spark.createDataFrame([], "cell int, id long, v array<double>").write.mode("overwrite").parquet(f"{path}/lists")
        index = cls(spark, path)
        return index.add(vectors, id_col, vector_col)

    def add(self, vectors: DataFrame, id_col: str = "id", vector_col: str = "embedding") -> VectorIndex:
        """The index with further vectors in the lists of their nearest centroids."""
        if len(self.centroids):
            listed = self._nearest(usable(vectors, id_col, vector_col), 1)
            listed.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").select("cell", "id", "v").write.mode("append").parquet(f"{self.path}/lists")
        return VectorIndex(self.spark, self.path)

    def _nearest(self, rows: DataFrame, probes: int) -> DataFrame:
        """rows(id, v) with each of the `probes` nearest cells."""
        c = self.centroids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    score = _fitting(_matrix(part["v"]), c.shape[1]) @ c.T
                    nearest = np.argsort(-score, axis=1, kind="stable")[:, :probes]
                    rows_of = pa.array(np.repeat(np.arange(part.num_rows), nearest.shape[1]))
                    yield pa.record_batch({"cell": nearest.ravel().astype(np.int32), "id": part["id"].take(rows_of), "v": part["v"].take(rows_of)})

        return rows.select("id", "v").mapInArrow(run, "cell int, id long, v array<double>")

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, id_col: str = "query_id", vector_col: str = "query_vector", min_score: float | None = None) -> DataFrame:
        """(query_id, id, score, rank) of the k most similar vectors among the lists that a query asks."""
        n = len(self.centroids)
        probes = min(n, probes or max(1, -int(-PROBED * n)))
        asks = self._nearest(usable(queries, id_col, vector_col), probes)
        asks = materialise(asks, "vector-asks")
        parts = lambda x, size, name: x.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
        cut = parts(self.lists, VECTORS, "list_parts").join(parts(asks, ASKS, "ask_parts"), "cell")
        cut = F.broadcast(materialise(cut, "vector-parts"))  # a row a cell
        held = self.lists.join(cut, "cell").select("cell", "id", "v", F.pmod(F.xxhash64("id"), F.col("list_parts")).cast("int").alias("lp"), F.explode(F.sequence(F.lit(0), F.col("ask_parts") - 1)).alias("ap"))
        asked = asks.join(cut, "cell").select(F.col("cell").alias("c"), F.col("id").alias("q"), F.col("v").alias("qv"), F.explode(F.sequence(F.lit(0), F.col("list_parts") - 1)).alias("l"), F.pmod(F.xxhash64("id"), F.col("ask_parts")).cast("int").alias("a"))

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            order = np.argsort(left["id"].to_numpy(), kind="stable")
            ids = left["id"].to_numpy()[order]
            m = _matrix(left["v"])[order]
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            for at in range(0, len(right) if len(ids) else 0, 256):
                some = right.slice(at, 256)
                score = _fitting(_matrix(some["qv"]), m.shape[1]) @ m.T
                score = np.copysign(np.floor(np.abs(score) * 1e6 + 0.5), score) / 1e6 + 0.0
                top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                out.append((np.repeat(some["q"].to_numpy(), top.shape[1]), ids[top].ravel(), np.take_along_axis(score, top, 1).ravel()))
            return pa.table({n: np.concatenate(x) for n, x in zip(("query_id", "id", "score"), zip(*out, strict=True), strict=True)})

        scored = held.groupBy("cell", "lp", "ap").cogroup(asked.groupBy("c", "l", "a")).applyInArrow(meet, "query_id long, id long, score double")
        ranked = best(scored, k, "score")
        return ranked if min_score is None else ranked.where(F.col("score") >= min_score)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """found with recall: the share of its query's exact rows (query_id, id) that are in it."""
    hits = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    shares = hits.groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
    return found.join(shares, "query_id", "left")

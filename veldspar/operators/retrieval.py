"""Lexical and vector retrieval, fusion, diversity, reranking, keywords and summaries."""

from __future__ import annotations

from collections.abc import Iterator
from typing import ClassVar

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veldspar.functions import constants as K
from veldspar.functions import text as X
from veldspar.operators.scratch import materialise, scratch_path

K1, B, FLOOR = 1.5, 0.75, 0.25
#: Rows that each search leg hands to fusion.
FETCH = 30


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term, tf): stems of words of two characters or more that are no stop words. Words are filtered and
    stemmed after the explode, in generated code."""
    raw = docs.select(F.col(id_col).alias("id"), F.explode(X.lexical_words(F.col(text_col))).alias("raw")).where(X.is_term(F.col("raw"), 2, K.STOP_LEXICAL))
    return raw.select("id", X.stem_first(F.col("raw"), K.SUFFIXES_LEXICAL, 2).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def term_df(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def index_stats(docs: DataFrame, post: DataFrame) -> DataFrame:
    """One row: documents, tokens, mean length, terms."""
    n = docs.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return post.agg(F.sum("tf").alias("tokens"), F.countDistinct("term").alias("terms")).select(n.alias("documents"), "tokens", (F.col("tokens") / n).alias("mean_length"), "terms")


def bm25(docs: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", where: Column | None = None) -> DataFrame:
    """(query_id, id, score, rank) of the k best documents of queries(query_id, text), ties to smaller ids.

    Rare-term weights are ln(N - df + .5) - ln(df + .5); negative ones become a quarter of the mean over all
    terms. A query term that is repeated counts again. The index is the one that the session holds for these documents, so texts
    are tokenised once, however many searches there are. where filters documents before they are ranked."""
    index = LexicalIndex.held(docs, id_col, text_col)
    return index.search(queries, k, None if where is None else docs.where(where).select(F.col(id_col).alias("id")))


def score_bm25(kept: DataFrame, lengths: DataFrame, frequencies: DataFrame, n: Column, tokens: Column, queries: DataFrame, k: int, mean_idf: Column | None = None) -> DataFrame:
    """The ranking of bm25 from the tables of an index."""
    idf = F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    mean_idf = frequencies.select(F.avg(idf).alias("m")).select("m").scalar() if mean_idf is None else mean_idf
    mean_length = tokens / n
    asked = postings(queries, "query_id", "text").select(F.col("id").alias("query_id"), "term", F.col("tf").alias("times"))
    weights = frequencies.withColumn("idf", F.when(idf < 0, FLOOR * mean_idf).otherwise(idf)).select("term", "idf")
    terms = asked.join(weights, "term")
    hit = kept.join(terms, "term").join(lengths, "id")
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / mean_length))
    scored = hit.groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score"))
    return best(scored, k, "score").where("score > 0")


class LexicalIndex:
    """An inverted index in a Parquet folder: postings sorted by term, document lengths, document
    frequencies, and corpus counts. Row groups without a query's terms are skipped when read. Documents can be
    added: each time adds files to the four tables, whose rows are added up when they are read."""

    #: Query terms up to which the postings' filter is a list that reaches the scan; results are the same without.
    PUSHED = 1000

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.post, self.lengths, parts = (spark.read.parquet(f"{path}/{t}") for t in ("postings", "lengths", "terms"))
        self.corpus = spark.read.parquet(f"{path}/corpus").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("times")).first()
        self.frequencies = parts if self.corpus.times == 1 else parts.groupBy("term").agg(F.sum("df").alias("df"))

    #: Folders of the indexes that this driver has built, by session, plan, files and bytes.
    HELD: ClassVar[dict[tuple, str]] = {}

    @classmethod
    def held(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LexicalIndex:
        """The index of a frame of files, built when it is first asked for. It is found again by the frame's plan and the names of its
        files; a table that is written anew has other files, and so another index. Postings aren't sorted, as whoever asks once
        would pay for it and gain nothing."""
        spark, files = docs.sparkSession, docs.inputFiles()
        key = (spark.sparkContext.applicationId, docs.semanticHash(), hash(tuple(sorted(files))), id_col, text_col)
        if not files or key not in cls.HELD:
            index = cls._write(docs, scratch_path(spark, "index"), id_col, text_col, "overwrite", ordered=False)
            if not files:
                return index
            cls.HELD[key] = index.path
        return cls(spark, cls.HELD[key])

    @classmethod
    def build(cls, docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> LexicalIndex:
        return cls._write(docs, path, id_col, text_col, "overwrite")

    @classmethod
    def _write(cls, docs: DataFrame, path: str, id_col: str, text_col: str, mode: str, ordered: bool = True) -> LexicalIndex:
        spark = docs.sparkSession
        made = postings(docs, id_col, text_col)
        if ordered:
            made = materialise(made, "postings")
            made.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode(mode).parquet(f"{path}/postings")
        else:
            made.write.mode(mode).parquet(f"{path}/postings")
            made = spark.read.parquet(f"{path}/postings")
        lengths = materialise(made.groupBy("id").agg(F.sum("tf").alias("dl")), "lengths")
        lengths.write.mode(mode).parquet(f"{path}/lengths")
        term_df(made).write.mode(mode).parquet(f"{path}/terms")
        tokens = lengths.agg(F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).select("tokens").scalar()
        docs.agg(F.count(F.lit(1)).alias("n")).select("n", tokens.alias("tokens")).write.mode(mode).parquet(f"{path}/corpus")
        return cls(spark, path)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LexicalIndex:
        """The index with further documents, whose ids must be new."""
        return self._write(docs, self.path, id_col, text_col, "append")

    def stats(self) -> DataFrame:
        """One row: documents, tokens, mean length, terms."""
        c = self.corpus
        return self.frequencies.agg(F.count(F.lit(1)).alias("terms")).select(F.lit(c.n).alias("documents"), F.lit(c.tokens).alias("tokens"), F.lit(c.tokens / c.n if c.n else 0.0).alias("mean_length"), "terms")

    def drop(self) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def search(self, queries: DataFrame, k: int = 20, among: DataFrame | None = None) -> DataFrame:
        """The ranking of bm25; among(id) holds the documents that may be ranked, all if None."""
        asked = postings(queries, "query_id", "text").select("term").distinct().limit(self.PUSHED + 1).collect()
        kept = self.post.where(F.col("term").isin([r.term for r in asked])) if len(asked) <= self.PUSHED else self.post
        kept = kept if among is None else kept.join(among, "id", "left_semi")
        c = self.corpus
        return score_bm25(kept, self.lengths, self.frequencies, F.lit(c.n), F.lit(c.tokens), queries, k)


def best(scored: DataFrame, k: int, by: str, group: str = "query_id", tie: str = "id") -> DataFrame:
    """The k rows of a group with the largest value, with their rank."""
    w = Window.partitionBy(group).orderBy(F.desc(by), tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Vectors of a block that one task compares with a block of queries.
VECTORS, ASKS = 16_384, 1024
#: Queries of a block in one product, and tasks that pairs of blocks are dealt to at most.
SIDE_BY_SIDE, TASKS = 64, 20_000


def _blocks(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    """(block, ids, lengths, data) of rows(id, v), in blocks of about size by a hash, and how many."""
    rows = materialise(rows, "vectors")
    n = max(1, -(-rows.count() // size))

    def pack(table: pa.Table) -> pa.Table:
        v = table["v"].combine_chunks()
        lengths = v.value_lengths().to_numpy(zero_copy_only=False).astype("<i4").tobytes()
        values = v.flatten().to_numpy(zero_copy_only=False).astype("<f8").tobytes()
        return pa.table({"block": table["block"][:1], "ids": pa.array([table["id"].to_numpy().astype("<i8").tobytes()], pa.binary()), "lengths": pa.array([lengths], pa.binary()), "data": pa.array([values], pa.binary())})

    salted = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    return materialise(salted.groupBy("block").applyInArrow(pack, "block int, ids binary, lengths binary, data binary"), "vector-blocks"), n


def _matrix(ids: bytes, lengths: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order and unit vectors, zero beyond their end."""
    key, n, v = np.frombuffer(ids, "<i8"), np.frombuffer(lengths, "<i4"), np.frombuffer(data, "<f8")
    out = np.zeros((len(key), int(n.max(initial=0))))
    out[np.repeat(np.arange(len(key)), n), np.arange(len(v)) - np.repeat(np.cumsum(n) - n, n)] = v
    size = np.linalg.norm(out, axis=1, keepdims=True)
    out = np.divide(out, size, out=np.zeros_like(out), where=size > 0)
    order = np.argsort(key, kind="stable")
    return key[order], out[order]


def vector_search(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector_col: str = "embedding", min_score: float | None = None, where: Column | None = None) -> DataFrame:
    """(query_id, id, score, rank): exact cosine search of queries(query_id, query_vector) against all vectors, ties to
    smaller ids. where filters vectors before they are ranked; the score threshold applies after the cut, so fewer than
    k rows can remain. Null vectors and those with null or non-finite components take no part; those of length zero are similar to nothing.

    Vectors and queries meet in blocks, each pair of blocks in a product of two matrices of which the k best of each
    query leave the task, so neither side is ever broadcast or multiplied out row by row."""
    vectors = vectors if where is None else vectors.where(where)
    rows = lambda df, i, v: df.select(F.col(i).cast("long").alias("id"), F.col(v).cast("array<double>").alias("v")).where("id is not null and v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    found, _ = _blocks(rows(vectors, id_col, vector_col), VECTORS)
    asked, n = _blocks(rows(queries, "query_id", "query_vector"), ASKS)
    spread = found.select("ids", "lengths", "data", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("ask"))
    spread = spread.join(asked.select(F.col("block").alias("ask"), *(F.col(c).alias(f"q_{c}") for c in ("ids", "lengths", "data"))), "ask")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, m = _matrix(r["ids"], r["lengths"], r["data"])
                asks, q = _matrix(r["q_ids"], r["q_lengths"], r["q_data"])
                width = min(m.shape[1], q.shape[1])
                at, best = [], []
                products = (row for i in range(0, len(q), SIDE_BY_SIDE) for row in q[i : i + SIDE_BY_SIDE, :width] @ m[:, :width].T)
                for product in products:
                    score = np.copysign(np.floor(np.abs(product) * 1e6 + 0.5), product) / 1e6
                    top = np.arange(len(ids))
                    if len(ids) > k:
                        least = np.partition(score, len(ids) - k)[len(ids) - k]
                        above = np.flatnonzero(score > least)
                        top = np.concatenate((above, np.flatnonzero(score == least)[: k - len(above)]))
                    at.append(ids[top])
                    best.append(score[top])
                sizes = [len(x) for x in at]
                yield pa.record_batch({"query_id": pa.array(np.repeat(asks, sizes)), "id": pa.array(np.concatenate(at)), "score": pa.array(np.concatenate(best) + 0.0)})

    scored = spread.repartition(max(1, min(found.count() * n, TASKS))).mapInArrow(run, "query_id long, id long, score double")
    kind = dict(queries.dtypes)["query_id"]
    ranked = best(scored.select(F.col("query_id").cast(kind).alias("query_id"), F.col("id").cast(dict(vectors.dtypes)[id_col]).alias("id"), "score"), k, "score")
    return ranked if min_score is None else ranked.where(F.col("score") >= min_score)


def vectors_where(vectors: DataFrame, meta: dict | None = None, text: str | None = None, meta_col: str = "meta", text_col: str = "text") -> DataFrame:
    """Rows of a vector table whose metadata have all given values and whose text has a phrase."""
    for key, value in (meta or {}).items():
        vectors = vectors.where(F.col(meta_col)[key] == F.lit(str(value)))
    return vectors if text is None else vectors.where(F.contains(F.col(text_col), F.lit(text)))


def fuse_rrf(semantic: DataFrame, lexical: DataFrame, k: int = 10, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion in one shuffle: sum of 1 / (constant + rank) over the lists."""
    x = semantic.select("query_id", "id", F.col("rank").alias("s"), F.lit(None).cast("int").alias("l"))
    x = x.unionByName(lexical.select("query_id", "id", F.lit(None).cast("int").alias("s"), F.col("rank").alias("l")))
    x = x.groupBy("query_id", "id").agg(F.max("s").alias("semantic_rank"), F.max("l").alias("lexical_rank"))
    part = lambda c: F.coalesce(F.lit(1.0) / (constant + F.col(c)), F.lit(0.0))
    return best(x.withColumn("score", F.round(part("semantic_rank") + part("lexical_rank"), 9)), k, "score")


def fuse_weighted(semantic: DataFrame, lexical: DataFrame, k: int = 10, semantic_weight: float = 0.6, lexical_weight: float = 0.4) -> DataFrame:
    """Weighted fusion; lexical scores are divided by ten and cut at one."""
    x = semantic.select("query_id", "id", F.col("score").alias("s"), F.lit(0.0).alias("l"))
    x = x.unionByName(lexical.select("query_id", "id", F.lit(0.0).alias("s"), F.least(F.lit(1.0), F.col("score") / 10).alias("l")))
    x = x.groupBy("query_id", "id").agg(F.sum("s").alias("semantic_score"), F.sum("l").alias("lexical_score"))
    return best(x.withColumn("score", F.round(semantic_weight * F.col("semantic_score") + lexical_weight * F.col("lexical_score"), 6)), k, "score")


def mmr_order(scores: list[float], word_sets: list[set[str]], weight: float = 0.7, picks: int | None = None) -> list[int]:
    """Positions by maximal marginal relevance: weight * score - (1 - weight) * largest similarity to those
    picked before; ties go to the earlier position."""
    left, out = list(range(len(scores))), []
    nearest = [0.0] * len(scores)
    while left and len(out) < (len(scores) if picks is None else picks):
        at = max(left, key=lambda i: (weight * scores[i] - (1 - weight) * nearest[i], -i))
        out.append(at)
        left.remove(at)
        for i in left:
            union = len(word_sets[i] | word_sets[at])
            nearest[i] = max(nearest[i], len(word_sets[i] & word_sets[at]) / union if union else 0.0)
    return out


def mmr(found: DataFrame, weight: float = 0.7, picks: int | None = None) -> DataFrame:
    """found(query_id, id, text, score, rank) reordered by MMR, with mmr_rank; likeness is of whole texts. A group is one query's
    candidates, which the search before has cut to FETCH rows."""

    def order(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank").reset_index(drop=True)
        sets = [set((t or "").lower().split()) for t in rows["text"]]
        at = mmr_order(rows["score"].tolist(), sets, weight, picks)
        return pd.DataFrame({"query_id": rows["query_id"][at].values, "id": rows["id"][at].values, "score": rows["score"][at].values, "mmr_rank": range(1, len(at) + 1)})

    return found.groupBy("query_id").applyInPandas(order, "query_id int, id long, score double, mmr_rank int")


def rerank_diverse(found: DataFrame, relevance: Column, k: int = 5, weight: float = 0.7) -> DataFrame:
    """found(query_id, id, text, score) reranked and, where a query has more than k rows, the k picked for relevance and
    against likeness to those picked before; likeness is of whole texts. (query_id, id, score, rank)."""
    x = rerank(found, relevance, 2**31 - 1).select("query_id", "id", "text", F.col("combined").alias("score"), "rank")

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank").reset_index(drop=True)
        sets = [set((t or "").lower().split()) for t in rows["text"]]
        at = mmr_order(rows["score"].tolist(), sets, weight, k) if len(rows) > k else list(range(len(rows)))
        return pd.DataFrame({"query_id": rows["query_id"][at].values, "id": rows["id"][at].values, "score": rows["score"][at].values, "rank": range(1, len(at) + 1)})

    return x.groupBy("query_id").applyInPandas(pick, "query_id int, id long, score double, rank int")


def rerank(found: DataFrame, relevance: Column, k: int = 5, min_score: float | None = None) -> DataFrame:
    """combined = .7 * relevance + .3 * score. Ranks are given before the threshold, so they can have gaps."""
    x = best(found.drop("rank").withColumn("combined", F.round(0.7 * relevance + 0.3 * F.col("score"), 6)), k, "combined")
    return x if min_score is None else x.where(F.col("combined") >= min_score)


def keywords(docs: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term, score, rank): (1 + ln tf) * ln(N / df), ties in order of the term."""
    raw = docs.select(F.col(id_col).alias("id"), F.explode(X.keyword_words(F.col(text_col))).alias("raw")).where(X.is_term(F.col("raw"), 3, K.STOP_KEYWORDS))
    tf = raw.select("id", X.stem_first(F.col("raw"), X.longest_first(K.SUFFIXES_KEYWORDS), 2).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    tf = materialise(tf, "terms")  # texts are tokenised once, for terms and for their frequencies
    n = docs.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    x = tf.join(term_df(tf), "term").withColumn("score", F.round((1 + F.log("tf")) * F.log(F.greatest(n, F.lit(1)) / F.col("df")), 6))
    return best(x, k, "score", group="id", tie="term").select("id", "term", "score", "rank")


def summaries(docs: DataFrame, top: DataFrame, most: int = 5, most_chars: int = 500, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, summary): the first sentence, the middle ones with most keywords, and the last, cut to length.
    Short texts are their own summary. top holds (id, term, rank) of the keywords."""
    terms = top.where("rank <= 10").groupBy("id").agg(F.collect_set("term").alias("terms"))
    clean = X.clean_text(F.col(text_col))
    x = docs.select(F.col(id_col).alias("id"), clean.alias("clean"), F.split(clean, r"(?<=[.!?])\s+").alias("s")).join(terms, "id", "left")
    # The terms column is a plain reference inside the lambda, so it is not built anew for each sentence.
    count = lambda s: F.size(F.filter(F.coalesce("terms", F.array().cast("array<string>")), lambda t: F.contains(F.lower(s), t)))
    middle = F.slice(F.col("s"), F.lit(2), F.size("s") - 2)
    scored = F.sort_array(F.transform(middle, lambda s, i: F.struct((-count(s)).alias("n"), i.alias("i"), s.alias("s"))))
    chosen = F.transform(F.slice(scored, 1, most - 2), lambda r: r["s"])
    built = F.array_join(F.concat(F.slice("s", 1, 1), chosen, F.slice("s", -1, 1)), " ")
    return x.select("id", F.substring(F.when(F.size("s") <= most, F.col("clean")).otherwise(built), 1, most_chars).alias("summary"))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of features a document: counts, category and language."""
    x = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), X.clean_text(F.col(text_col)).alias("clean"))
    c, clean = F.col("text"), F.col("clean")
    kind = X.category(clean)
    return x.select(
        "id", F.length(clean).cast("long").alias("chars"), F.size(X.words(clean)).cast("long").alias("words"), F.size(F.split(clean, r"(?<=[.!?])\s+")).cast("long").alias("sentences"),
        F.size(X.paragraphs(c, 1)).cast("long").alias("paragraphs"), kind["name"].alias("category"), X.is_turkish(clean).alias("language"),
    )

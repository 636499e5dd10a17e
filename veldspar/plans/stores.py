"""Queries of stored structures: a vector index, sketches, tables with versions, variants, and tables in folders."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldspar.operators import ann as A
from veldspar.operators import retrieval as R
from veldspar.operators import sketches as S
from veldspar.operators import variants as V
from veldspar.operators.scratch import materialise, scratch_path
from veldspar.plans.registry import query, table
from veldspar.plans.retrieval import _VEC, _cut, _vectors
from veldspar.sources.changes import ChangeTable
from veldspar.sources.layout import read_by, write_by
from veldspar.sources.listing import listed


@query()
def vector_ann(spark, sf_dir):
    """The ten nearest by an index that asks some of its cells, with the share of the exact ten that each query found."""
    v, q = _vectors(spark, sf_dir)
    found = A.VectorIndex.build(v, id_col="vec_id").search(q, 10)
    return A.recall(materialise(found, "vector-found"), R.vector_search(v, q, 10, "vec_id"))


@query(f"SELECT query_id, id, score, rank FROM {_cut(f'({_VEC})', 10)}")
def vector_index(spark, sf_dir):
    """All cells of an index that was built from two thirds of the vectors and got the others later: an exact search."""
    v, q = _vectors(spark, sf_dir)
    index = A.VectorIndex.build(v.where("vec_id % 3 > 0"), id_col="vec_id").add(v.where("vec_id % 3 = 0"), "vec_id")
    return index.search(q, 10, probes=A.CELLS)


def _sketches(spark, sf_dir):
    """Sketches of each day, from a table of them."""
    return materialise(S.sketched(table(spark, sf_dir, "events"), ["event_type"], F.to_date("ts"), "user_id", "value"), "sketches")


def _cells(spark, sf_dir):
    """Sketches of each day and cell of users, from a table of them."""
    events = table(spark, sf_dir, "events")
    return materialise(S.celled(events, ["event_type"], F.to_date("ts"), "user_id", S.cells_of(events, "user_id")), "sketches")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def sketch_distinct(spark, sf_dir):
    """Distinct users from daily theta sketches of cells of users: exact, however many there are."""
    found = S.distinct_in_cells(S.merged_cells(_cells(spark, sf_dir), ["event_type"]), ["event_type"])
    return found.select("event_type", "n", F.col("distinct_theta").alias("users"))


@query("""WITH u AS (SELECT DISTINCT event_type, user_id FROM events), p(a, b) AS (VALUES ('view', 'click'), ('click', 'purchase'), ('signup', 'purchase'))
SELECT a, b, (SELECT count(*) FROM u x JOIN u y ON x.user_id = y.user_id WHERE x.event_type = a AND y.event_type = b) AS both,
  (SELECT count(DISTINCT user_id) FROM u WHERE event_type IN (a, b)) AS either,
  (SELECT count(*) FROM u x WHERE x.event_type = a AND NOT EXISTS (SELECT 1 FROM u y WHERE y.user_id = x.user_id AND y.event_type = b)) AS only_a FROM p""")
def sketch_overlap(spark, sf_dir):
    """Users that the steps of a funnel share, from their sketches alone."""
    steps = spark.createDataFrame([("view", "click"), ("click", "purchase"), ("signup", "purchase")], "a string, b string")
    return S.overlaps_in_cells(materialise(S.merged_cells(_cells(spark, sf_dir), ["event_type"]), "sketch-cells"), steps, "event_type")


@query("SELECT event_type, s AS share, true AS within, true AS near FROM (SELECT DISTINCT event_type FROM events), (SELECT unnest([0.1, 0.5, 0.9]::DOUBLE[]) AS s)")
def sketch_bounds(spark, sf_dir):
    """Whether quantiles of merged sketches lie within their rank error, and distinct counts within theirs, held against all rows."""
    shares = (0.1, 0.5, 0.9)
    told = S.answered(S.merged(_sketches(spark, sf_dir), ["event_type"]), ["event_type"], shares)
    asked = told.select("event_type", "n", "distinct_hll", F.posexplode("quantiles").alias("i", "q"))
    rows = table(spark, sf_dir, "events").join(F.broadcast(asked), "event_type")
    x = rows.groupBy("event_type", "i", "n", "distinct_hll").agg((F.count_if(F.col("value") < F.col("q")) / F.count("value")).alias("below"), (F.count_if(F.col("value") <= F.col("q")) / F.count("value")).alias("upto"), F.countDistinct("user_id").alias("users"))
    share = F.element_at(F.array(*map(F.lit, shares)), F.col("i") + 1)
    within = (F.col("below") <= share + S.RANK_ERROR) & (F.col("upto") >= share - S.RANK_ERROR)
    return x.select("event_type", share.alias("share"), within.alias("within"), (F.abs(F.col("distinct_hll") - F.col("users")) <= F.greatest(F.lit(1), S.COUNT_ERROR * F.col("users"))).alias("near"))


def _versions(spark, sf_dir):
    """A table of vectors: all of them, then a third changed, a third deleted, a compaction, and half of the deleted ones back."""
    v = table(spark, sf_dir, "embeddings")
    held = ChangeTable(spark, scratch_path(spark, "versions"), "vec_id", v.schema)
    held.upsert(v)
    held.upsert(v.where("vec_id % 3 = 0").withColumn("label", F.col("label") + 100))
    held.delete(v.where("vec_id % 3 = 1"))
    held.compact()
    held.upsert(v.where("vec_id % 6 = 1").withColumn("label", F.lit(-1)))
    return held


@query("""SELECT version, vec_id, CASE WHEN version > 1 AND vec_id % 3 = 0 THEN label + 100 WHEN version = 4 AND vec_id % 6 = 1 THEN -1 ELSE label END::INT AS label, round(list_sum(embedding::DOUBLE[]), 6) AS total
FROM embeddings, (SELECT unnest([3, 4]) AS version) WHERE vec_id % 3 <> 1 OR (version = 4 AND vec_id % 6 = 1)""")
def table_versions(spark, sf_dir):
    """Upserts and deletes, read as of two versions, of which the first is a base that was compacted."""
    held = _versions(spark, sf_dir)
    read = lambda n: held.snapshot(n).select(F.lit(n).alias("version"), "vec_id", F.col("label").cast("int").alias("label"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))
    return read(3).unionByName(read(4))


@query("SELECT vec_id, label AS before, NULL::INT AS after FROM embeddings WHERE vec_id % 3 = 1 UNION ALL SELECT vec_id, label, label + 100 FROM embeddings WHERE vec_id % 3 = 0")
def table_changes(spark, sf_dir):
    """What differs between two versions of a table."""
    v = table(spark, sf_dir, "embeddings")
    held = ChangeTable(spark, scratch_path(spark, "versions"), "vec_id", v.schema)
    held.upsert(v)
    held.upsert(v.where("vec_id % 3 = 0").withColumn("label", F.col("label") + 100))
    held.delete(v.where("vec_id % 3 = 1"))
    return held.changes(1).select(F.col("key").alias("vec_id"), F.col("before.label").cast("int").alias("before"), F.col("after.label").cast("int").alias("after"))


@query("SELECT event_type, count(*) AS n, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS total, max(json_extract(props, '$.k')::BIGINT) AS largest, count(*) FILTER (WHERE json_extract(props, '$.none') IS NULL) AS without FROM events GROUP BY event_type")
def event_variants(spark, sf_dir):
    """Typed values of a JSON column: numbers are added up as numbers."""
    x = V.typed(V.parsed(table(spark, sf_dir, "events"), "props"), "variant", {"k": ("$.k", "bigint"), "none": ("$.none", "string")})
    return x.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"), F.max("k").alias("largest"), F.count_if(F.col("none").isNull()).alias("without"))


@query("""SELECT name, kind, count(*) AS n, count(DISTINCT value) AS n_values FROM (SELECT k AS name, CASE json_type(props, '$.' || k) WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'VARCHAR' THEN 'STRING' ELSE json_type(props, '$.' || k) END AS kind, json_extract(props, '$.' || k)::VARCHAR AS value
FROM (SELECT props, unnest(json_keys(props)) AS k FROM events)) GROUP BY name, kind""")
def event_fields(spark, sf_dir):
    """The fields of a JSON column with the kinds of their values."""
    x = V.entries(V.parsed(table(spark, sf_dir, "events"), "props"), "variant", [])
    return x.groupBy("name", "kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("n_values"))


_DAYS = "SELECT CAST(ts AS DATE) AS day FROM events GROUP BY CAST(ts AS DATE) HAVING count(*) FILTER (WHERE event_type = 'purchase') > 1.1 * count(*) FILTER (WHERE event_type = 'click')"


@query(f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events WHERE CAST(ts AS DATE) IN ({_DAYS}) GROUP BY ALL")
def events_of_days(spark, sf_dir):
    """Events by day, read from the folders of the days on which purchases outnumber clicks, which are found at run time."""
    path = scratch_path(spark, "events-by-day")
    write_by(table(spark, sf_dir, "events"), path, "day", F.to_date("ts"), ["event_type"])
    of = lambda kind: F.count_if(F.col("event_type") == kind)
    days = spark.read.parquet(path).groupBy("day").agg(of("purchase").alias("p"), of("click").alias("c")).where(F.col("p") > 1.1 * F.col("c"))
    rows = read_by(spark, path, days, "day")
    return rows.groupBy(F.col("day").cast("string").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


def _listing(spark, sf_dir):
    """A listing of the files of documents, which are written by source first."""
    path = scratch_path(spark, "documents-by-source")
    write_by(table(spark, sf_dir, "documents").select("doc_id", "source"), path, "source", F.coalesce("source", F.lit("none")))
    return listed(spark, path)


@query("SELECT 'source=' || coalesce(source, 'none') AS folder, 'unknown' AS category, ceil(count(*) / 1000000.0)::BIGINT AS files FROM documents GROUP BY ALL")
def files_listed(spark, sf_dir):
    """The files of a table in folders, listed by a data source of its own."""
    return _listing(spark, sf_dir).where("extension = 'parquet' and size > 0").groupBy("folder", "category").agg(F.count(F.lit(1)).alias("files"))


@query("SELECT 'source=src1' AS folder, count(DISTINCT source) AS files FROM documents WHERE source = 'src1' HAVING count(*) > 0")
def files_of_folder(spark, sf_dir):
    """The files of one folder; the filter is pushed down, so no other folder is listed."""
    return _listing(spark, sf_dir).where("folder = 'source=src1' and extension in ('parquet', 'csv')").groupBy("folder").agg(F.count(F.lit(1)).alias("files"))


@query()
def token_counts(spark, sf_dir):
    """Tokens of every document by a public byte-level vocabulary (merging is sequential, so without SQL)."""
    import public_tokenizers

    from veldspar.functions.tokens import token_count

    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", token_count(F.col("text"), public_tokenizers.path("byte_bpe_50k.tiktoken")).alias("tokens"))

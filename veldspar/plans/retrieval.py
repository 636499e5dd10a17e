"""Queries of retrieval, keywords and context."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veldspar.functions import constants as K
from veldspar.functions import text as X
from veldspar.operators import context as C
from veldspar.operators import retrieval as R
from veldspar.operators.providers import relevance_by
from veldspar.operators.scratch import scratch_path
from veldspar.plans.registry import query, quoted, table, value_rows
from veldspar.plans.scalar import _CLEAN, _CAT_SQL, _SENTENCES, _TOKENS, _TR, WORDS, _stem_sql

QUERIES = [(1, "licensed under the apache license"), (2, "the thing and the of disgusting clown"), (3, "ciones de la que 3.0"), (4, "der die das keit schen"), (5, "contact email address license license")]


def _queries(spark):
    return spark.createDataFrame(QUERIES, "query_id int, text string")


_Q = f"(VALUES {value_rows(QUERIES)}) q(query_id, text)"
_LEXICAL = WORDS.format(r"regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\p{Nd}+', ' NUM ', 'g')")
_TERMS = f"list_filter({_LEXICAL}, lambda w: length(w) >= 2 AND w NOT IN ({quoted(K.STOP_LEXICAL)}))"
_POST = f"""post AS (SELECT doc_id AS id, term, count(*) AS tf FROM (SELECT doc_id, {_stem_sql('raw', K.SUFFIXES_LEXICAL, 2)} AS term FROM (SELECT doc_id, unnest({_TERMS}) AS raw FROM documents)) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term)"""
_BM25 = f"""{_POST},
n AS (SELECT count(*) AS n FROM documents), dl AS (SELECT id, sum(tf) AS dl FROM post GROUP BY id), av AS (SELECT sum(tf) / max(n) AS avgdl FROM post, n),
idf0 AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, n), mean AS (SELECT avg(idf) AS m FROM idf0),
ask AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, {_stem_sql('raw', K.SUFFIXES_LEXICAL, 2)} AS term FROM (SELECT query_id, unnest({_TERMS}) AS raw FROM {_Q})) GROUP BY ALL),
bs AS (SELECT query_id, id, round(sum(times * (CASE WHEN idf < 0 THEN 0.25 * m ELSE idf END) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM post JOIN ask USING (term) JOIN idf0 USING (term) JOIN dl USING (id), mean, av GROUP BY query_id, id)"""


def _cut(source: str, k: int, by: str = "score", group: str = "query_id", tie: str = "id") -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {by} DESC, {tie})::INT AS rank FROM {source} QUALIFY rank <= {k})"


@query(f"WITH {_BM25} SELECT query_id, id, score, rank FROM {_cut('bs', 10)} WHERE score > 0")
def bm25_topk(spark, sf_dir):
    return R.bm25(table(spark, sf_dir, "documents"), _queries(spark), 10)


@query(f"WITH {_BM25} SELECT query_id, id, score, rank FROM {_cut('bs', 10)} WHERE score > 0")
def bm25_index(spark, sf_dir):
    """The same ranking from an index to which a third of the documents was added later."""
    docs = table(spark, sf_dir, "documents")
    index = R.LexicalIndex.build(docs.where("doc_id % 3 > 0"), scratch_path(spark, "index"))
    return index.add(docs.where("doc_id % 3 = 0")).search(_queries(spark), 10)


@query(f"WITH {_BM25} SELECT query_id, id, score, rank FROM {_cut('(SELECT * FROM bs WHERE id IN (SELECT doc_id FROM documents WHERE lang = ' + chr(39) + 'en' + chr(39) + '))', 10)} WHERE score > 0")
def bm25_filtered(spark, sf_dir):
    return R.bm25(table(spark, sf_dir, "documents"), _queries(spark), 10, where=F.col("lang") == "en")


@query(f"WITH {_POST} SELECT term, df FROM df")
def bm25_term_df(spark, sf_dir):
    return R.term_df(R.postings(table(spark, sf_dir, "documents")))


@query(f"WITH {_POST} SELECT term, df FROM df ORDER BY df DESC, term LIMIT 20")
def bm25_top_terms(spark, sf_dir):
    return R.term_df(R.postings(table(spark, sf_dir, "documents"))).orderBy(F.desc("df"), "term").limit(20)


@query(f"WITH {_POST} SELECT (SELECT count(*) FROM documents) AS documents, sum(tf)::BIGINT AS tokens, sum(tf) / (SELECT count(*) FROM documents) AS mean_length, count(DISTINCT term) AS terms FROM post")
def bm25_stats(spark, sf_dir):
    return R.LexicalIndex.build(table(spark, sf_dir, "documents"), scratch_path(spark, "index")).stats()


_VEC = "SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0"


def _vectors(spark, sf_dir):
    """All vectors, and as queries every row whose id is divisible by 50."""
    v = table(spark, sf_dir, "embeddings")
    return v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


@query(f"SELECT query_id, id, score, rank, 1 - score AS distance FROM {_cut(f'({_VEC})', 10)}")
def vector_topk(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    return R.vector_search(v, q, 10, "vec_id").withColumn("distance", 1 - F.col("score"))


@query(f"SELECT query_id, id, score, rank FROM {_cut(f'({_VEC})', 5)} WHERE score >= 0.3")
def vector_threshold(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    return R.vector_search(v, q, 5, "vec_id", min_score=0.3)


@query(f"SELECT query_id, id, score, rank FROM {_cut(f'({_VEC} AND v.label = 3)', 5)}")
def vector_filtered(spark, sf_dir):
    """Search among the vectors whose metadata have a value."""
    v, q = _vectors(spark, sf_dir)
    v = v.withColumn("meta", F.create_map(F.lit("label"), F.col("label").cast("string")))
    return R.vector_search(R.vectors_where(v, {"label": 3}), q, 5, "vec_id")


@query("SELECT doc_id FROM documents WHERE source = 'src1' AND lang = 'en' AND contains(text, 'license')")
def vector_where_document(spark, sf_dir):
    """Rows of a vector table by metadata and by a phrase of their text."""
    d = table(spark, sf_dir, "documents").withColumn("meta", F.create_map(F.lit("source"), "source", F.lit("lang"), "lang"))
    return R.vectors_where(d, {"source": "src1", "lang": "en"}, "license").select("doc_id")


_EMB = "[" + ", ".join(f"('0x' || h[{2 * i + 1}:{2 * i + 2}])::INT / 255::DOUBLE" for i in range(32)) + "]"
_LEGS = f"""{_BM25}, lex AS (SELECT query_id, id, score, rank FROM {_cut('bs', 30)} WHERE score > 0),
de AS (SELECT doc_id AS id, {_EMB} AS v FROM (SELECT doc_id, sha256(text) AS h FROM documents)), qe AS (SELECT query_id, {_EMB} AS v FROM (SELECT query_id, sha256(text) AS h FROM {_Q})),
sem AS {_cut('(SELECT query_id, id, round(list_cosine_similarity(qe.v, de.v), 6) AS score FROM qe, de)', 30)}"""


def _legs(spark, sf_dir):
    docs, q = table(spark, sf_dir, "documents"), _queries(spark)
    semantic = R.vector_search(docs.select("doc_id", X.hash_embedding(F.col("text")).alias("embedding")), q.select("query_id", X.hash_embedding(F.col("text")).alias("query_vector")), R.FETCH, "doc_id")
    return semantic, R.bm25(docs, q, R.FETCH)


_RRF = f"""WITH {_LEGS}, u AS (SELECT query_id, id, max(s) AS semantic_rank, max(l) AS lexical_rank FROM (SELECT query_id, id, rank AS s, NULL::INT AS l FROM sem UNION ALL SELECT query_id, id, NULL, rank FROM lex) GROUP BY ALL),
f AS (SELECT *, round(coalesce(1.0::DOUBLE / (60 + semantic_rank), 0) + coalesce(1.0::DOUBLE / (60 + lexical_rank), 0), 9) AS score FROM u)"""


@query(f"{_RRF} SELECT * FROM {_cut('f', 10)}")
def hybrid_rrf(spark, sf_dir):
    return R.fuse_rrf(*_legs(spark, sf_dir))


@query(f"""WITH {_LEGS}, u AS (SELECT query_id, id, sum(s) AS semantic_score, sum(l) AS lexical_score FROM (SELECT query_id, id, score AS s, 0.0::DOUBLE AS l FROM sem UNION ALL SELECT query_id, id, 0.0, least(1.0, score / 10) FROM lex) GROUP BY ALL),
f AS (SELECT *, round(0.6 * semantic_score + 0.4 * lexical_score, 6) AS score FROM u) SELECT * FROM {_cut('f', 10)}""")
def hybrid_weighted(spark, sf_dir):
    return R.fuse_weighted(*_legs(spark, sf_dir))


@query()
def mmr_select(spark, sf_dir):
    """The fused candidates reordered for diversity (sequential, so without SQL)."""
    found = R.fuse_rrf(*_legs(spark, sf_dir), k=R.FETCH).select("query_id", "id", "score", "rank")
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return R.mmr(found.join(texts, "id"))


@query(f"""{_RRF}, c AS (SELECT f.query_id, f.id, f.score, q.text AS ask, d.text AS body FROM {_cut('f', 20)} f JOIN documents d ON d.doc_id = f.id JOIN {_Q} ON q.query_id = f.query_id),
w AS (SELECT query_id, id, score, list_distinct({WORDS.format('lower(ask)')}) AS a, list_distinct({WORDS.format('lower(body)')}) AS b FROM c),
s AS (SELECT query_id, id, score, round(0.7 * (len(list_intersect(a, b)) / len(a)) + 0.3 * score, 6) AS combined FROM w) SELECT * FROM {_cut('s', 5, 'combined')}""")
def rerank_overlap(spark, sf_dir):
    """Reranking by the share of query words that a document has."""
    found = R.fuse_rrf(*_legs(spark, sf_dir), k=20).select("query_id", "id", "score")
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), X.lower_words(F.col("text")).alias("b"))
    asks = _queries(spark).select("query_id", X.lower_words(F.col("text")).alias("a"))
    x = found.join(texts, "id").join(asks, "query_id")
    return R.rerank(x, X.keyword_overlap(F.col("a"), F.col("b")), 5).select("query_id", "id", "score", "combined", "rank")


def shared_words(pairs: list[tuple[str, str]]) -> list[float]:
    """A model of pairs without weights: the share of the query's words that the text has."""
    sets = ((set(a.lower().split()), set(b.lower().split())) for a, b in pairs)
    return [len(a & b) / len(a) if a else 0.0 for a, b in sets]


@query(f"""{_RRF}, c AS (SELECT f.query_id, f.id, f.score, q.text AS ask, d.text AS body FROM {_cut('f', 20)} f JOIN documents d ON d.doc_id = f.id JOIN {_Q} ON q.query_id = f.query_id),
w AS (SELECT query_id, id, score, list_distinct({WORDS.format('lower(ask)')}) AS a, list_distinct({WORDS.format('lower(body)')}) AS b FROM c),
s AS (SELECT query_id, id, score, round(0.7 * (len(list_intersect(a, b)) / len(a)) + 0.3 * score, 6) AS combined FROM w) SELECT query_id, id, combined, rank FROM {_cut('s', 5, 'combined')} WHERE combined >= 0.3""")
def rerank_model(spark, sf_dir):
    """Reranking by a model that is given pairs of texts, and the relevant rows alone: ranks are given before the threshold."""
    found = R.fuse_rrf(*_legs(spark, sf_dir), k=20).select("query_id", "id", "score")
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    x = found.join(texts, "id").join(_queries(spark), "query_id")
    judged = relevance_by(x, F.col("text"), F.col("body"), shared_words)
    return R.rerank(judged, F.col("relevance"), 5, 0.3).select("query_id", "id", "combined", "rank")


_KTOK = f"list_filter({WORDS.format(r'regexp_replace(lower(text), ' + chr(39) + r'[^a-zçğıöşü\s]' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}, lambda w: length(w) >= 3 AND w NOT IN ({quoted(K.STOP_KEYWORDS)}))"
_KEY = f"""ktf AS (SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, {_stem_sql('raw', X.longest_first(K.SUFFIXES_KEYWORDS), 2)} AS term FROM (SELECT doc_id, unnest({_KTOK}) AS raw FROM documents)) GROUP BY ALL),
kdf AS (SELECT term, count(*) AS df FROM ktf GROUP BY term), ks AS (SELECT id, term, round((1 + ln(tf)) * ln((SELECT count(*) FROM documents)::DOUBLE / df), 6) AS score FROM ktf JOIN kdf USING (term)),
kw AS {_cut('ks', 20, 'score', 'id', 'term')}"""


@query(f"WITH {_KEY} SELECT * FROM kw")
def tfidf_keywords(spark, sf_dir):
    return R.keywords(table(spark, sf_dir, "documents"))


_CLEAN_SENT = _SENTENCES.replace("text", "clean")


@query(f"""WITH {_KEY}, kt AS (SELECT id, list(term) AS terms FROM kw WHERE rank <= 10 GROUP BY id),
s AS (SELECT doc_id AS id, clean, {_CLEAN_SENT} AS s, terms FROM (SELECT doc_id, {_CLEAN} AS clean FROM documents) d LEFT JOIN kt ON kt.id = d.doc_id),
m AS (SELECT id, i, s[i] AS sentence, len(list_filter(coalesce(terms, []), lambda t: contains(lower(s[i]), t))) AS n FROM (SELECT *, unnest(range(2, len(s)::BIGINT)) AS i FROM s WHERE len(s) > 5)),
p AS (SELECT id, string_agg(sentence, ' ' ORDER BY n DESC, i) AS mid FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, i) AS r FROM m QUALIFY r <= 3) GROUP BY id)
SELECT s.id, (CASE WHEN len(s) <= 5 THEN clean ELSE s[1] || ' ' || mid || ' ' || s[-1] END)[:500] AS summary FROM s LEFT JOIN p USING (id)""")
def extractive_summary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return R.summaries(docs, R.keywords(docs, 10))


@query(rf"""WITH d AS (SELECT doc_id, text AS raw, {_CLEAN} AS text FROM documents),
c AS ({_CAT_SQL.replace('FROM documents', 'FROM d')}), s AS (SELECT doc_id, text[:1000] AS s FROM d),
n AS (SELECT *, length(regexp_replace(s, '[^\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(s, '[^çğıöşüÇĞİÖŞÜ]', '', 'g')) AS tr FROM s)
SELECT doc_id AS id, length(text) AS chars, len({WORDS.format('text')}) AS words, len({_SENTENCES}) AS sentences,
  len(list_filter(string_split(raw, chr(10) || chr(10)), lambda p: length(trim(p)) >= 1)) AS paragraphs, category,
  CASE WHEN letters > 0 AND tr / letters > 0.01 THEN 'tr' WHEN {_TR} >= 3 THEN 'tr' ELSE 'en' END AS language FROM d JOIN c USING (doc_id) JOIN n USING (doc_id)""")
def doc_features(spark, sf_dir):
    return R.features(table(spark, sf_dir, "documents"))


# Context assembly


@query("SELECT doc_id, lower(trim(text))[:200] AS key FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(text))[:200] ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedup_prefix(spark, sf_dir):
    return C.first_by_prefix(table(spark, sf_dir, "documents"), "text", "doc_id").select("doc_id", F.substring(F.lower(F.trim("text")), 1, 200).alias("key"))


_W100 = "list_distinct(" + WORDS.format("lower(text)") + "[:100])"


_CLASSES = f"""w AS (SELECT doc_id, list_sort({_W100}) AS w FROM documents), c AS (SELECT w, min(doc_id) AS class, count(*) AS n FROM w WHERE len(w) > 0 GROUP BY w)"""
_ALIKE = """p AS (SELECT a.class AS a, b.class AS b, len(list_intersect(a.w, b.w)) AS n, len(a.w) + len(b.w) AS total FROM c a JOIN c b ON a.class < b.class AND least(len(a.w), len(b.w)) >= {least} * greatest(len(a.w), len(b.w)))"""


@query(f"""WITH {_CLASSES}, {_ALIKE.format(least=0.5)} SELECT a, b, round(n / (total - n), 6) AS similarity FROM p WHERE n / (total - n) >= 0.5""")
def jaccard_pairs(spark, sf_dir):
    """Similar pairs among all documents; those of equal words are one class, named by its least id."""
    return C.similar_classes(_word_sets(spark, sf_dir), 0.5)[0]


@query(f"""WITH {_CLASSES}, {_ALIKE.format(least=0.5)}, s AS (SELECT a, b FROM p WHERE n / (total - n) >= 0.5), e AS (SELECT a, b FROM s UNION ALL SELECT b, a FROM s),
l AS (SELECT a AS class, sum(n) AS others FROM e JOIN c ON c.class = e.b GROUP BY a)
SELECT doc_id, c.class, (coalesce(others, 0) + n - 1)::BIGINT AS n_links FROM w JOIN c ON c.w = w.w LEFT JOIN l ON l.class = c.class""")
def jaccard_links(spark, sf_dir):
    """Each document's class and how many others are similar to it."""
    return C.similar_classes(_word_sets(spark, sf_dir), 0.5)[1]


def _word_sets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(X.first_lower_words(F.col("text"), 100)).alias("w"))


@query()
def dedup_greedy(spark, sf_dir):
    """Greedy removal of documents similar to a kept earlier one (sequential: the SQL of a pass in order did not end on a thousand documents,
    so a plain pass is the test)."""
    return C.greedy_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), 0.8)


@query(f"""WITH q AS (SELECT list_distinct({WORDS.format("lower('the license and the clown of thing')")}) AS q),
s AS (SELECT doc_id AS id, 1 AS query_id, round(0.4 * (len(list_intersect(q, list_distinct({WORDS.format('lower(text)')}))) / len(q)) + 0.6 * (n_chars % 100 / 100.0::DOUBLE), 6) AS score FROM documents, q)
SELECT id, score, rank FROM {_cut('s', 10)}""")
def rank_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", (F.col("n_chars") % 100 / F.lit(100.0)).alias("score"))
    return C.rank_by_query(docs, "the license and the clown of thing", 10)


_QW = f"list_distinct({WORDS.format(chr(39) + 'the thing and clown' + chr(39))})"


@query(f"""WITH s AS (SELECT doc_id, unnest({_SENTENCES}) AS sentence FROM documents), w AS (SELECT doc_id, sentence, list_distinct({WORDS.format('lower(sentence)')}) AS w, {_QW} AS q FROM s),
n AS (SELECT *, len(list_intersect(w, q)) AS n FROM w WHERE len(w) > 0)
SELECT doc_id, count(*) AS n_relevant, sum(length(sentence))::BIGINT AS chars FROM n WHERE (n / (len(w) + len(q) - n) + n / len(q)) / 2 >= 0.3 GROUP BY doc_id""")
def compress_sentences(spark, sf_dir):
    return C.relevant_sentences(table(spark, sf_dir, "documents"), "the thing and clown").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_relevant"), F.sum(F.length("sentence")).alias("chars"))


@query(f"""WITH t AS (SELECT doc_id, source, {_TOKENS} AS tokens FROM documents), c AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY doc_id) AS upto FROM t)
SELECT doc_id, source, tokens, upto::BIGINT AS upto, CASE WHEN upto <= 2000 THEN tokens ELSE 2000 - (upto - tokens) - 50 END::BIGINT AS used, upto > 2000 AS truncated
FROM c WHERE upto <= 2000 OR (upto - tokens < 2000 AND 2000 - (upto - tokens) >= 100)""")
def context_budget(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", X.token_estimate(F.col("text")).alias("tokens"))
    return C.pack_budget(docs, 2000, "source", "doc_id")


@query(f"""WITH b AS (SELECT benchmark.item_id, list_distinct({WORDS.format('lower(benchmark.text)')}) AS q FROM benchmark), d AS (SELECT doc_id AS id, list_distinct({WORDS.format('lower(text)')}) AS w FROM documents),
s AS (SELECT item_id AS query_id, id, round(len(list_intersect(q, w)) / len(q), 6) AS score FROM b, d), c AS {_cut('(SELECT * FROM s WHERE score > 0)', 3)} SELECT query_id, id, score, rank FROM c""")
def benchmark_overlap(spark, sf_dir):
    """Documents with the largest share of an item's words, through an index of words."""
    words = lambda t, i: table(spark, sf_dir, t).select(F.col(i), F.explode(F.array_distinct(X.lower_words(F.col("text")))).alias("word"))
    items = words("benchmark", "item_id")
    sizes = items.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    both = items.join(words("documents", "doc_id"), "word").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("hits"))
    x = both.join(sizes, "item_id").select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("id"), F.round(F.col("hits") / F.col("n"), 6).alias("score"))
    return R.best(x, 3, "score")


@query("SELECT doc_id, source, n, rank FROM (SELECT doc_id, source, n_chars % 7 AS n, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN n_chars % 7 IN (2, 5) THEN 0 ELSE 1 END, doc_id)::INT AS rank FROM documents)")
def prioritize_preferred(spark, sf_dir):
    """A stable partition: rows of preferred kinds first."""
    n = F.col("n_chars") % 7
    w = Window.partitionBy("source").orderBy(n.isin(2, 5).desc(), "doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "source", n.alias("n"), F.row_number().over(w).alias("rank"))


@query("SELECT doc_id, rank FROM (SELECT doc_id, row_number() OVER (ORDER BY round(0.7 * (n_chars % 100 / 100.0::DOUBLE) + 0.3 / (doc_id % 10 + 1), 6) DESC, doc_id)::INT AS rank FROM documents) WHERE rank <= 50")
def balanced_priority(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select("doc_id", F.round(0.7 * (F.col("n_chars") % 100 / F.lit(100.0)) + 0.3 / (F.col("doc_id") % 10 + 1), 6).alias("score"))
    return x.orderBy(F.desc("score"), "doc_id").limit(50).select("doc_id", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).alias("rank"))

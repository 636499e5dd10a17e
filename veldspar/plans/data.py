"""Queries of fixed tables, parsed answers, sinks, and the whole path from documents to a context."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldspar.functions import text as X
from veldspar.operators import chunking as H
from veldspar.operators import context as C
from veldspar.operators import providers as P
from veldspar.operators import retrieval as R
from veldspar.operators.scratch import materialise
from veldspar.plans.registry import query, table, value_rows
from veldspar.plans.retrieval import _queries, WORDS
from veldspar.plans.reports import _SEC, _sections
from veldspar.sources import dims as D
from veldspar.sources import sinks as Z

_STAT = f"(VALUES {value_rows(D.STATISTICS)}) s(indicator, value, unit, period, description)"


@query(f"SELECT * FROM {_STAT}")
def national_statistics(spark, sf_dir):
    return D.statistics(spark)


@query(f"""SELECT indicator, '| ' || description || ' | ' || CASE WHEN value >= 1e6 THEN format('{{:,.1f}}', value / 1e6) || 'M' WHEN value >= 1e3 THEN format('{{:,.1f}}', value / 1e3) || 'K' ELSE format('{{:,.2f}}', value) END || ' ' || unit || ' | ' || period || ' |' AS line FROM {_STAT}""")
def statistics_table(spark, sf_dir):
    return D.statistics_table(spark)


@query(f"SELECT sector, max(value) AS largest, count(*) AS n FROM (VALUES {value_rows(D.SECTOR_DATA)}) s(sector, measure, value) GROUP BY sector")
def sector_data(spark, sf_dir):
    return D.sectors(spark).groupBy("sector").agg(F.max("value").alias("largest"), F.count(F.lit(1)).alias("n"))


@query(f"SELECT city, population::BIGINT AS population, gdp_share::DOUBLE AS gdp_share FROM (VALUES {value_rows(D.CITIES)}) c(city, population, gdp_share)")
def city_data(spark, sf_dir):
    return D.cities(spark)


@query(f"SELECT f.indicator, f.value, c.value / 1e12 AS credits FROM (VALUES {value_rows(D.FINANCIAL)}) f(indicator, value, unit, description, date) LEFT JOIN (VALUES {value_rows(D.CREDITS)}) c(kind, value) ON c.kind = 'total_credits' AND f.indicator = 'credit_rate'")
def financial_indicators(spark, sf_dir):
    c = D.credits(spark).where("kind = 'total_credits'").select(F.lit("credit_rate").alias("indicator"), (F.col("value") / 1e12).alias("credits"))
    return D.financial(spark).select("indicator", "value").join(c, "indicator", "left")


@query(f"SELECT category, count(*) AS n, string_agg(indicator, ', ' ORDER BY indicator) AS names FROM (VALUES {value_rows(D.INDICATORS)}) i(indicator, description, unit, category) GROUP BY category")
def indicator_categories(spark, sf_dir):
    return D.indicators(spark).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("indicator")), ", ").alias("names"))


@query(f"SELECT indicator, description FROM (VALUES {value_rows(D.INDICATORS)}) i(indicator, description, unit, category) WHERE indicator IN ('dolar_kuru', 'euro_kuru')")
def exchange_rates(spark, sf_dir):
    return D.indicators(spark).where(F.col("indicator").isin(*D.EXCHANGE)).select("indicator", "description")


TOPICS = [("kahve", "is_plani"), ("oyun", "bilinmeyen")]
_PHRASES = value_rows([(k, i, p) for k, ps in D.SEARCH_TEMPLATES.items() for i, p in enumerate(ps)])


@query(f"""SELECT topic, report_type, n, replace(phrase, '{{topic}}', topic) AS phrase FROM (VALUES {value_rows(TOPICS)}) t(topic, report_type)
JOIN (VALUES {_PHRASES}) p(kind, n, phrase) ON kind = CASE WHEN report_type IN ('is_plani', 'pazar_analizi', 'fizibilite') THEN report_type ELSE 'default' END""")
def search_phrases(spark, sf_dir):
    return D.search_phrases(spark.createDataFrame(TOPICS, "topic string, report_type string"))


@query("SELECT o_orderkey, o_totalprice AS amount, round_even((o_totalprice / 37.0)::DOUBLE, 2) AS usd, round_even((o_totalprice * 37.0)::DOUBLE, 2) AS tl FROM orders")
def currency_conversion(spark, sf_dir):
    return D.convert(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("amount")), 37.0)


# Answers of a text provider.
ANSWERS = [
    (1, "DEĞER: 64,77\nDÖNEM: Aralık 2024\nKAYNAK: TÜİK", "SKOR: 82/100\nSORUNLAR:\n- kısa\n- kaynak yok\nÖNERİLER:\n- uzat\nÖZET: iyi metin", "## ÖZET\nKısa özet.\n## ANAHTAR BİLGİLER\n1. Bir\n- İki\nara\n## İSTATİSTİKLER\n• %5 artış\n## KAYNAK\nx"),
    (2, "bilinmiyor", "serbest metin", "boş"),
]


@query("SELECT * FROM (VALUES (1, 64.77::DOUBLE, 'Aralık 2024', 'TÜİK'), (2, NULL, NULL, NULL)) t(id, value, period, source)")
def parse_indicator(spark, sf_dir):
    x = spark.createDataFrame(ANSWERS, "id int, a string, b string, c string")
    return x.select("id", P.indicator(F.col("a")).alias("r")).select("id", "r.*")


@query("SELECT * FROM (VALUES (1, 82, 'kısa; kaynak yok', 'uzat', 'iyi metin', true), (2, 75, '', '', '', true)) t(id, score, issues, suggestions, summary, again)")
def parse_critique(spark, sf_dir):
    x = spark.createDataFrame(ANSWERS, "id int, a string, b string, c string").select("id", P.critique(F.col("b")).alias("r"))
    return x.select("id", "r.score", F.array_join("r.issues", "; ").alias("issues"), F.array_join("r.suggestions", "; ").alias("suggestions"), "r.summary", P.improved(F.col("r.score"), F.col("r.issues")).alias("again"))


@query("SELECT * FROM (VALUES (1, 'Kısa özet.', 'Bir; İki', '%5 artış'), (2, '', '', '')) t(id, summary, facts, statistics)")
def parse_research(spark, sf_dir):
    x = spark.createDataFrame(ANSWERS, "id int, a string, b string, c string").select("id", P.research(F.col("c")).alias("r"))
    return x.select("id", "r.summary", F.array_join("r.facts", "; ").alias("facts"), F.array_join("r.statistics", "; ").alias("statistics"))


@query("SELECT * FROM (VALUES (1, 3, 'TÜİK'), (2, 0, NULL)) t(id, n, source)")
def parse_key_values(spark, sf_dir):
    x = spark.createDataFrame(ANSWERS, "id int, a string, b string, c string").select("id", P.key_values(F.col("a")).alias("m"))
    return x.select("id", F.size("m").alias("n"), F.col("m")["KAYNAK"].alias("source"))


@query(f"""SELECT report_id, string_agg(repeat('#', level) || ' ' || ord || '. ' || title || chr(10) || chr(10) || content, chr(10) || chr(10) ORDER BY ord) AS text FROM {_SEC} GROUP BY report_id""")
def markdown_report(spark, sf_dir):
    return Z.markdown_report(_sections(spark))


@query(f"SELECT '| Bölüm | Başlık |' AS head, count(*)::BIGINT AS n FROM {_SEC}")
def markdown_table_sink(spark, sf_dir):
    x = Z.markdown_table(_sections(spark).withColumnsRenamed({"section_id": "Bölüm", "title": "Başlık"}).withColumn("o", F.col("report_id") * 100 + F.col("ord")), ["Bölüm", "Başlık"], "o")
    lines = F.split("table", "\n")
    return x.select(lines[0].alias("head"), (F.size(lines) - 2).cast("long").alias("n"))


@query(f"SELECT report_id, to_json(list({{ord: ord, section_id: section_id, title: title, level: level, content: content}} ORDER BY ord))::VARCHAR AS json FROM {_SEC} GROUP BY report_id")
def json_report(spark, sf_dir):
    return Z.json_report(_sections(spark))


@query("SELECT source AS key, max_by(doc_id, doc_id) AS value FROM documents WHERE doc_id % 48 < 24 GROUP BY source")
def cache_fresh(spark, sf_dir):
    """Cache rows younger than a day; the age of a row is its id modulo 48, in hours."""
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    age = F.make_dt_interval(hours=(F.col("doc_id") % 48).cast("int"))
    x = table(spark, sf_dir, "documents").select(F.col("source").alias("key"), F.col("doc_id").alias("value"), (now - age).alias("made"), "doc_id")
    alive = x.where(F.col("made") > now - F.make_dt_interval(hours=F.lit(24)))
    return alive.groupBy("key").agg(F.max_by("value", "doc_id").alias("value"))


@query("SELECT doc_id AS key FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def cache_misses(spark, sf_dir):
    """Documents that no label was made for yet."""
    return Z.misses(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key")), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key")))


@query("SELECT key, used FROM (SELECT doc_id AS key, n_chars AS used, row_number() OVER (ORDER BY n_chars, doc_id) AS n FROM documents) WHERE n > floor((SELECT count(*) FROM documents) * 0.2)")
def cache_evict(spark, sf_dir):
    return Z.evict(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("n_chars").alias("used")), 100)


@query(f"""WITH s AS (SELECT doc_id, generate_subscripts(x, 1) AS n, unnest(x) AS s FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS x FROM documents)),
w AS (SELECT doc_id, n, s, regexp_matches(s, '[0-9]') AS num, length(s) < 200 AND len(list_intersect(list_distinct({WORDS.format('lower(s)')}), ['and', 'of', 'the', 'thing'])) >= 2 AS hit FROM s),
a AS (SELECT doc_id, s, 0 AS kind, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS r FROM w WHERE num) WHERE r <= 2 UNION ALL SELECT doc_id, s, 1, n FROM w WHERE hit),
d AS (SELECT doc_id, s, min(kind * 1000000 + n) AS o FROM a GROUP BY ALL), t AS (SELECT doc_id, string_agg(s, ' | ' ORDER BY o) AS points FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS r FROM d) WHERE r <= 5 GROUP BY doc_id)
SELECT w.doc_id, coalesce(points, '') AS points FROM (SELECT DISTINCT doc_id FROM documents) w LEFT JOIN t USING (doc_id)""")
def key_points(spark, sf_dir):
    return C.key_points(table(spark, sf_dir, "documents"), "the thing and of").select("doc_id", F.array_join("points", " | ").alias("points"))


@query("SELECT g, string_agg('[' || n || '] ' || source || chr(10) || text, chr(10) || chr(10) ORDER BY n) AS context FROM (SELECT doc_id // 5 AS g, source, text, row_number() OVER (PARTITION BY doc_id // 5 ORDER BY doc_id) AS n FROM documents) GROUP BY g")
def context_format(spark, sf_dir):
    """Whole texts, five documents to a context."""
    d = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 5).alias("g"), "doc_id", "source", "text")
    return C.format_context(d, "g", "doc_id")


@query()
def report_context(spark, sf_dir):
    """From documents to a context for each query: chunks, both search legs, fusion, one of each prefix,
    ranking, the token budget and the numbered text."""
    made = H.chunks(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "semantic")
    # Chunks are cut once, for both legs and for the texts of what they find.
    made = materialise(made.select((F.col("id") * 100_000 + F.col("pos")).alias("chunk_id"), F.col("id").alias("doc_id"), F.col("chunk").alias("text")), "context-chunks")
    asks = _queries(spark)
    vectors = P.embed(made, F.col("text")).select("chunk_id", "embedding")
    wanted = P.embed(asks, F.col("text"), query=True).select("query_id", F.col("embedding").alias("query_vector"))
    found = R.fuse_rrf(R.vector_search(vectors, wanted, R.FETCH, "chunk_id"), R.bm25(made, asks, R.FETCH, "chunk_id"), k=20)
    texts = found.select("query_id", "id", "score", "rank").join(made.select(F.col("chunk_id").alias("id"), "doc_id", "text"), "id")
    key = F.concat_ws("|", F.col("query_id").cast("string"), F.substring(F.lower(F.trim("text")), 1, 200))
    unique = texts.groupBy(key.alias("k")).agg(F.min_by(F.struct("query_id", "id", "doc_id", "score", "rank", "text"), "rank").alias("r")).select("r.*")
    packed = unique.withColumn("tokens", X.token_estimate(F.col("text")) + 20)
    fits = C.pack_budget(packed, 2000, "query_id", "rank").select("query_id", "rank", "used")
    rows = unique.join(fits, ["query_id", "rank"]).select("query_id", "rank", F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("source"), "text")
    return C.format_context(rows, "query_id", "rank")



"""Queries of rewriting with a provider, context styles, report texts and their files."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldspar.functions import constants as K
from veldspar.functions import numbers as N
from veldspar.functions import text as X
from veldspar.operators import context as C
from veldspar.operators import providers as P
from veldspar.operators import retrieval as R
from veldspar.operators import rewriting as W
from veldspar.operators import sources as S
from veldspar.operators import validation as V
from veldspar.plans.chunks import _ASKS, ASKS
from veldspar.plans.registry import query, table, value_rows
from veldspar.plans.reports import _CITE, _SEC, _citations, _sections
from veldspar.plans.retrieval import _BM25, _Q, _cut, _legs, _queries
from veldspar.plans.scalar import _TOKENS
from veldspar.sources import files as D
from veldspar.sources import media as M
from veldspar.sources import rendering as G
from veldspar.sources import sinks as Z


def _asks(spark):
    return spark.createDataFrame(ASKS, "query_id int, text string")


def answers(prompts: list[str]) -> list[str]:
    """A provider that answers with the last line of the prompt in two ways, and a blank line between."""
    last = [p.rpartition("\n")[2].partition(": ")[2] for p in prompts]
    return [f"{x} nedir\n\n{x} neden\n{x} nerede" if "gelir" not in x or len(x) > 5 else "" for x in last]


_FIRST = "CASE WHEN text = 'gelir' THEN text ELSE text || ' nedir' || chr(10) || chr(10) || text || ' neden' || chr(10) || text || ' nerede' END"


@query(f"SELECT query_id, text, {_FIRST} AS variant FROM {_ASKS}")
def query_hypothetical(spark, sf_dir):
    """An ideal answer to search with; the query itself where the provider has none."""
    return W.hypothetical(_asks(spark), answers)


@query(f"SELECT query_id, text AS variant, 1 AS n FROM {_ASKS} UNION ALL SELECT query_id, text || ' nedir', 2 FROM {_ASKS} WHERE text <> 'gelir' UNION ALL SELECT query_id, text || ' neden', 3 FROM {_ASKS} WHERE text <> 'gelir'")
def query_multiple(spark, sf_dir):
    return W.multiple(_asks(spark), answers)


@query(f"""SELECT query_id, 'decomposition' AS strategy, text AS variant, 1 AS n FROM {_ASKS} WHERE query_id = 4 UNION ALL SELECT query_id, 'multi_query', text, 1 FROM {_ASKS} WHERE query_id IN (1, 3)
UNION ALL SELECT query_id, 'multi_query', text || ' nedir', 2 FROM {_ASKS} WHERE query_id IN (1, 3) UNION ALL SELECT query_id, 'multi_query', text || ' neden', 3 FROM {_ASKS} WHERE query_id IN (1, 3)
UNION ALL SELECT * FROM (VALUES (2, 'expansion', 'gelir', 1), (2, 'expansion', 'hasilat', 2), (2, 'expansion', 'ciro', 3), (5, 'expansion', 'risk ile firsat', 1), (5, 'expansion', 'tehlike ile firsat', 2), (5, 'expansion', 'belirsizlik ile firsat', 3), (5, 'expansion', 'risk ile olanak', 4), (5, 'expansion', 'risk ile sans', 5)) t(query_id, strategy, variant, n)""")
def query_optimised(spark, sf_dir):
    """Each query by its strategy, with a provider at hand."""
    return W.optimise(_asks(spark), answers)


@query(f"SELECT query_id, 'hyde' AS strategy, {_FIRST} AS variant, 1 AS n FROM {_ASKS}")
def query_hyde(spark, sf_dir):
    return W.optimise(_asks(spark), answers, "hyde")


@query(f"SELECT query_id, 'none' AS strategy, text AS variant, 1 AS n FROM {_ASKS}")
def query_without_provider(spark, sf_dir):
    """A strategy that wants a provider leaves queries as they are where there is none."""
    return W.optimise(_asks(spark), None, "multi_query")


SUBJECTS = [(1, "is_plani", "kahve zinciri için yeni bir büyüme planı", "Dosyada pazar var"), (2, "sunum", None, ""), (3, "proje_raporu", "  ", None)]
_SUBJECTS = f"(VALUES {value_rows(SUBJECTS)}) s(id, kind, notes, body)"


@query(f"""SELECT id, CASE WHEN trim(coalesce(notes, '')) <> '' THEN 'kahve zinciri için yeni bir - ' ELSE '' END || CASE kind WHEN 'is_plani' THEN 'İş Planı' WHEN 'sunum' THEN 'Sunum' ELSE 'Proje Raporu' END || ' 2025' AS title,
CASE id WHEN 1 THEN 'iş planı hazırlama; pazar analizi yöntemleri; kahve zinciri için yeni bir büyüme planı; Dosyada pazar var sektör analizi' WHEN 2 THEN 'iş analizi' ELSE 'proje yönetimi; proje planlama' END AS topics FROM {_SUBJECTS}""")
def report_titles(spark, sf_dir):
    x = spark.createDataFrame(SUBJECTS, "id int, kind string, notes string, body string")
    return x.select("id", W.title(F.col("kind"), F.col("notes"), 2025).alias("title"), F.array_join(W.research_topics(F.col("kind"), F.col("notes"), F.col("body")), "; ").alias("topics"))


PLAN = [("pazar_analizi", 600, True, 2, 0), ("ekler", 100, False, 0, 0), ("giris", 200, True, 1, 1)]


@query("SELECT * FROM (VALUES (NULL, 'few_words_in_all'), ('pazar_analizi', 'no_sources'), ('ekler', 'no_key_points'), ('giris', 'few_words')) t(section, warning)")
def plan_warnings(spark, sf_dir):
    return W.plan_warnings(spark.createDataFrame(PLAN, "section string, target_words int, required boolean, n_points int, n_sources int"))


_CHUNKS = f"(SELECT doc_id // 5 AS g, doc_id AS pos, source, text, doc_id % 100 / 100.0::DOUBLE AS score, {_TOKENS} AS tokens FROM documents)"


def _rows(spark, sf_dir):
    """Whole documents with their tokens, five to a context, so that contexts grow in number and not in length."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 5).alias("g"), F.col("doc_id").alias("pos"), "source", text, (F.col("doc_id") % 100 / 100).alias("score"), X.token_estimate(text).alias("tokens"))


_TOTAL = "chr(10) || chr(10) || '---' || chr(10) || 'Toplam: ' || count(*) || ' dokuman, ' || sum(tokens) || ' token'"


@query(f"""SELECT g, string_agg('[' || n || '] (Kaynak: ' || source || ', Skor: ' || printf('%.2f', score) || ')' || chr(10) || text || chr(10), chr(10) ORDER BY pos) || {_TOTAL} AS context FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY pos) AS n FROM {_CHUNKS}) GROUP BY g""")
def context_numbered(spark, sf_dir):
    return C.styled_context(_rows(spark, sf_dir), "g", "pos")


@query(f"""SELECT g, '## Ilgili Dokumanlar' || chr(10) || chr(10) || string_agg('### Kaynak ' || n || chr(10) || '*Kaynak: ' || source || ' | Skor: ' || printf('%.2f', score) || '*' || chr(10) || chr(10) || text || chr(10), chr(10) ORDER BY pos) || {_TOTAL} AS context FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY pos) AS n FROM {_CHUNKS}) GROUP BY g""")
def context_markdown(spark, sf_dir):
    return C.styled_context(_rows(spark, sf_dir), "g", "pos", "markdown")


@query(f"SELECT g, string_agg(text || chr(10), chr(10) ORDER BY pos) AS context FROM {_CHUNKS} GROUP BY g")
def context_simple(spark, sf_dir):
    return C.styled_context(_rows(spark, sf_dir), "g", "pos", "simple", metadata=False)


@query(f"SELECT g, substr(string_agg(text, chr(10) || chr(10) ORDER BY pos), 1, 2000) AS text FROM {_CHUNKS} GROUP BY g")
def context_compressed(spark, sf_dir):
    """The texts of a group made one; without a provider, their beginning."""
    return C.compress_with(_rows(spark, sf_dir), "g", "pos", F.lit("soru"))


_HEAD = r"regexp_extract(text, '^\s*(?:\S+\s+){66}\S+', 0)"


@query(f"""WITH t AS (SELECT doc_id, text, {_TOKENS} AS n, {_HEAD} AS head FROM documents)
SELECT doc_id, CASE WHEN n <= 100 THEN text ELSE substr(text, 1, CASE WHEN length(head) > 0 THEN least(length(head), 350) ELSE 350 END) || '...' END AS text FROM t""")
def truncated_to_tokens(spark, sf_dir):
    """Whole texts, or as much of their beginning as a hundred tokens hold."""
    return table(spark, sf_dir, "documents").select("doc_id", X.truncate_tokens(F.col("text"), 100).alias("text"))


@query(r"""SELECT page_id, regexp_replace(url, '[<>:"/\\|?*]', '_', 'g') AS name FROM pages""")
def file_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.sanitize_filename(F.col("url")).alias("name"))


@query("SELECT o_orderkey, CASE WHEN s < 60 THEN printf('%.1f', round_even(s, 1)) || 's' WHEN s < 3600 THEN printf('%.1f', round_even(s / 60, 1)) || 'm' ELSE printf('%.1f', round_even(s / 3600, 1)) || 'h' END AS took FROM (SELECT o_orderkey, (o_orderkey * 7 % 9000)::DOUBLE AS s FROM orders)")
def durations(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", N.format_duration(F.col("o_orderkey") * 7 % 9000).alias("took"))


@query("SELECT l_orderkey, l_linenumber, greatest(0.0::DOUBLE, least(1.0::DOUBLE, l_discount * 20 - 0.5)) AS score, (0.6 * l_tax + 0.4 * l_discount) / 1.0 AS mean, 0.0::DOUBLE AS nothing FROM (SELECT l_orderkey, l_linenumber, l_discount::DOUBLE AS l_discount, l_tax::DOUBLE AS l_tax FROM lineitem)")
def score_means(spark, sf_dir):
    d, t = F.col("l_discount").cast("double"), F.col("l_tax").cast("double")
    x = table(spark, sf_dir, "lineitem")
    mean = N.weighted_average(F.array(t, d), F.array(F.lit(0.6), F.lit(0.4)))
    return x.select("l_orderkey", "l_linenumber", N.clamp(d * 20 - 0.5).alias("score"), mean.alias("mean"), N.weighted_average(F.array().cast("array<double>")).alias("nothing"))


GROWTH = [(1, "a", "Beklenen büyüme: 250 olur, artış 600% ve growth 20."), (1, "b", "düşüş 90."), (2, "a", "increase: 1.200,5 % beklenir")]


@query("SELECT * FROM (VALUES (1, 'a', 250.0::DOUBLE, 'warning'), (1, 'a', 600.0, 'error'), (2, 'a', 1200.5, 'error')) t(report_id, section_id, value, severity)")
def fin_growth_rates(spark, sf_dir):
    return V.growth_rates(spark.createDataFrame(GROWTH, "report_id int, section_id string, content string"))


@query("SELECT * FROM (VALUES (1, 'net_margin', 55.0::DOUBLE, 1.0::DOUBLE, 10.0::DOUBLE), (2, 'gross_margin', 60.0, 15.0, 45.0), (2, 'net_margin', 20.0, 1.0, 10.0)) t(report_id, ratio, value, low, high)")
def fin_margins_in_sector(spark, sf_dir):
    return V.margins_out_of_range(_sections(spark), "perakende")


@query("SELECT * FROM (VALUES (1, 5), (2, 2)) t(report_id, n_metrics)")
def consistency_reports(spark, sf_dir):
    """The metrics of a report, and what differs, as a text."""
    x = V.consistency_report(_sections(spark))
    return x.select("report_id", F.size(F.filter(F.split("text", "\n"), lambda s: s.rlike(r"^\w+:$"))).alias("n_metrics"))


_CITED = f"{_CITE}, f AS (SELECT url, row_number() OVER (ORDER BY min(pos)) AS n FROM cite GROUP BY url), c AS (SELECT pos, n, cite.url, section, 'x' || pos AS text FROM cite JOIN f ON f.url = cite.url)"


def _cited(spark, sf_dir):
    return S.number_citations(_citations(spark, sf_dir)).withColumn("text", F.concat(F.lit("x"), F.col("pos").cast("string")))


@query(f"WITH {_CITED} SELECT section, '## ' || section || chr(10) || chr(10) || string_agg('- [' || n || '] ' || text || '... (' || url || ')', chr(10) ORDER BY pos) AS text FROM c GROUP BY section")
def citations_markdown(spark, sf_dir):
    return S.citations_markdown(_cited(spark, sf_dir))


@query(f"WITH {_CITED} SELECT to_json(list({{pos: pos, n: n, url: url, section: section, text: text}} ORDER BY pos))::VARCHAR AS json FROM c")
def citations_json(spark, sf_dir):
    return S.citations_json(_cited(spark, sf_dir))


RESULTS = [("giris", 80, True, ["kısa", "kaynak yok", "uzun"]), ("pazar", 91, False, []), ("sonuc", 60, True, ["boş"])]


@query("SELECT 3::BIGINT AS sections, 2::BIGINT AS improved, 77.0::DOUBLE AS mean_score, 'giris: 80/100 + (kısa, kaynak yok)' || chr(10) || 'pazar: 91/100' || chr(10) || 'sonuc: 60/100 + (boş)' AS lines")
def improvement_summary(spark, sf_dir):
    return P.improvement_summary(spark.createDataFrame(RESULTS, "section string, score int, improved boolean, issues array<string>"))


@query(f"SELECT section, least_words AS target, 5 * (least_words // 5 + 1) AS words FROM (VALUES {value_rows([(s, *t) for s, t in K.SECTION_TARGETS.items()])}) t(section, least_words, most_words, paragraphs)")
def written_sections(spark, sf_dir):
    """Sections that a provider writes; its first drafts are too short and are lengthened."""

    def write(prompts: list[str]) -> list[str]:
        short = "bir iki üç dört beş "
        return [short if p.startswith("Write") else short * (int(p.split()[3]) // 5 + 1) for p in prompts]

    plan = W.content_plan(spark).select("section", F.col("section").alias("title"), F.col("least_words").alias("target_words"), "queries")
    context = plan.select("section", F.lit("kaynak").alias("context"))
    return P.write_sections(plan, context, write).join(plan, "section").select("section", F.col("target_words").alias("target"), "words")


_SECTION_ASKS = "(VALUES " + value_rows([(s, t.replace("{title}", "license clown")) for s, t in K.SECTION_QUERIES.items()]) + ") q(query_id, text)"


@query(f"WITH {_BM25.replace(_Q, _SECTION_ASKS)} SELECT query_id AS section, id, score, rank FROM {_cut('bs', 5)} WHERE score > 0")
def section_search(spark, sf_dir):
    """The documents found for each section of a report by its own query."""
    asks = W.section_query(spark, "license clown").select(F.col("section").alias("query_id"), "text")
    return R.bm25(table(spark, sf_dir, "documents"), asks, 5).withColumnRenamed("query_id", "section")


@query()
def rerank_diverse(spark, sf_dir):
    """Reranked candidates picked for relevance and against likeness (sequential, so without SQL)."""
    found = R.fuse_rrf(*_legs(spark, sf_dir), k=20).select("query_id", "id", "score")
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    asks = _queries(spark).select("query_id", X.lower_words(F.col("text")).alias("a"))
    x = found.join(texts, "id").join(asks, "query_id")
    return R.rerank_diverse(x.withColumn("rank", F.lit(0)), X.keyword_overlap(F.col("a"), X.lower_words(F.col("text"))), 5)


CHARTS = [(1, "Özet", "pie", [40.0, 60.0]), (1, "Pazar", "bar", [1.0, 2.0, 3.0]), (2, "Kapak", "bar", [5.0])]


def _docx_counts(content: bytes) -> tuple[int, int]:
    """Headings and pictures of a text document."""
    return sum(level > 0 for _, _, level in D.docx_paragraphs(content)), D.docx_stats(content)[2]


def _charts(spark):
    return spark.createDataFrame(CHARTS, "report_id int, title string, kind string, values array<double>")


@query(f"SELECT report_id, n_sections, coalesce(n_charts, 0) AS n_charts FROM (SELECT report_id, count(*) AS n_sections FROM {_SEC} GROUP BY report_id) LEFT JOIN (SELECT report_id, count(*) AS n_charts FROM (VALUES (1, 'Özet'), (1, 'Pazar'), (2, 'Kapak')) c(report_id, title) GROUP BY report_id) USING (report_id)")
def docx_reports(spark, sf_dir):
    """DOCX reports with charts, read back: numbered headings and pictures."""
    made = Z.docx_reports(_sections(spark), _charts(spark))

    @F.udf("struct<n_sections long, n_charts long>")
    def read(content):
        return _docx_counts(bytes(content))

    return made.select("report_id", read("content").alias("r")).select("report_id", "r.*")


@query(f"SELECT report_id, n_sections, coalesce(n_charts, 0) AS n_charts FROM (SELECT report_id, count(*) AS n_sections FROM {_SEC} GROUP BY report_id) LEFT JOIN (SELECT report_id, count(*) AS n_charts FROM (VALUES (1, 'Özet'), (1, 'Pazar'), (2, 'Kapak')) c(report_id, title) GROUP BY report_id) USING (report_id)")
def pdf_reports(spark, sf_dir):
    """PDF reports with charts, read back: numbered headings and pictures."""
    import re

    made = G.pdf_reports(_sections(spark), _charts(spark))

    @F.udf("struct<n_sections long, n_charts long>")
    def read(content):
        text = "\n".join(M.pdf_pages(bytes(content)))
        return len(re.findall(r"(?m)^\d+\. ", text)), len(M.pdf_pictures(bytes(content)))

    return made.select("report_id", read("content").alias("r")).select("report_id", "r.*")


@query("SELECT * FROM (VALUES (1, 'Özet', 'PNG', 480::BIGINT, 300::BIGINT), (1, 'Pazar', 'PNG', 480, 300), (2, 'Kapak', 'PNG', 480, 300)) t(report_id, title, format, width, height)")
def chart_files(spark, sf_dir):
    made = G.chart_files(_charts(spark).withColumn("labels", F.array().cast("array<string>")))

    @F.udf("struct<format string, width long, height long>")
    def read(content):
        return M.picture(bytes(content))

    return made.select("report_id", "title", read("content").alias("r")).select("report_id", "title", "r.*")


@query("SELECT source, count(*) AS n_bars FROM (SELECT DISTINCT source, lang FROM documents) GROUP BY source")
def chart_svg(spark, sf_dir):
    """A bar chart of the languages of each source, as SVG text."""
    x = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).cast("double").alias("n")).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("lang", "n"))).alias("b"))
    svg = G.chart_svg(F.transform("b", lambda r: r["lang"]), F.transform("b", lambda r: r["n"]))
    return x.select("source", F.size(F.regexp_extract_all(svg, F.lit("<rect "), F.lit(0))).cast("long").alias("n_bars"))


_PATHS = [(1, "/data/in/a.pdf"), (2, " "), (3, None), (4, "/data/in/../b.pdf"), (5, "/etc/hosts"), (6, "/data/out/c.pdf"), (7, "/data/in/c.exe"), (8, " /data/in/d.PDF ")]


@query("SELECT * FROM (VALUES (1, NULL), (2, 'empty'), (3, 'empty'), (4, 'traversal'), (5, 'traversal'), (6, 'outside'), (7, 'extension'), (8, NULL)) t(id, problem)")
def path_validation(spark, sf_dir):
    x = spark.createDataFrame(_PATHS, "id int, path string")
    return x.select("id", X.path_problem(F.col("path"), F.array(F.lit(".pdf"), F.lit(".csv")), "/data/in").alias("problem"))


@query("SELECT 1 AS report_id, 'pazar_buyuklugu' AS metric, [50.0::DOUBLE, 58.0::DOUBLE] AS \"values\"")
def logic_disagreements(spark, sf_dir):
    return V.disagreements(_sections(spark))


def found_online(queries: list[str]) -> list[list[tuple[str, str, str]]]:
    """A search provider of two results a query."""
    return [[(f"{q} {n}", f"https://site{n}.org/{q}", f"{q} verisi") for n in (1, 2, 3)] for q in queries]


@query("SELECT source AS query, n - 1 AS pos, source || ' ' || n AS title, 'https://site' || n || '.org/' || source AS url, source || ' verisi' AS snippet FROM (SELECT DISTINCT source FROM documents), (SELECT unnest([1, 2]) AS n)")
def provider_search(spark, sf_dir):
    """The first two results of a search provider for each source's name."""
    return P.search(table(spark, sf_dir, "documents").select(F.col("source").alias("query")).distinct(), found_online, 2)


@query("SELECT source AS query, '- ' || source || ' 1 (https://site1.org/' || source || '): ' || source || ' verisi' || chr(10) || '- ' || source || ' 2 (https://site2.org/' || source || '): ' || source || ' verisi' AS text FROM (SELECT DISTINCT source FROM documents)")
def research_summaries(spark, sf_dir):
    return P.research_summary(P.search(table(spark, sf_dir, "documents").select(F.col("source").alias("query")).distinct(), found_online, 2))


@query("SELECT event_id, 'rapor_' || strftime(ts, '%Y%m%d_%H%M%S') || '.docx' AS name FROM events")
def timed_file_names(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.timed_filename("rapor", F.col("ts"), ".docx").alias("name"))


@query("SELECT page_id, round_even(0.4 * (page_id % 11 / 10.0::DOUBLE) + 0.4 * 0.5 + 0.2 * 0.8, 3) AS confidence FROM pages WHERE round_even(0.4 * (page_id % 11 / 10.0::DOUBLE) + 0.4 * 0.5 + 0.2 * 0.8, 3) >= 0.5")
def confident_sources(spark, sf_dir):
    """Sources of a confidence of at least one half, by their relevance."""
    x = table(spark, sf_dir, "pages").select("page_id", N.confidence(F.col("page_id") % 11 / 10, F.lit(0.5), F.lit(0.8)).alias("confidence"))
    return x.where("confidence >= 0.5")

"""Queries of sources, citations and report checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldspar.functions import constants as K
from veldspar.functions import numbers as N
from veldspar.functions import text as X
from veldspar.operators import sources as S
from veldspar.operators import validation as V
from veldspar.plans.registry import query, quoted, table, value_rows
from veldspar.plans.scalar import _DOMAIN, WORDS

# Sources are taken from pages: the address without its query is the key, its path gives the title.
_SRC = f"""src AS (SELECT split_part(url, '?', 1) AS url, {_DOMAIN} AS title, regexp_extract(html, '<title>([^<]*)</title>', 1) AS snippet, 'q' || (page_id % 4) AS query, page_id AS pos FROM pages)"""


def _found(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select(F.split_part("url", F.lit("?"), F.lit(1)).alias("url"), N.domain(F.col("url")).alias("title"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("snippet"), F.concat(F.lit("q"), (F.col("page_id") % 4).cast("string")).alias("query"), F.col("page_id").alias("pos"))


@query(f"WITH {_SRC} SELECT url, min_by(title, pos) AS title, min_by(snippet, pos) AS snippet, string_agg(DISTINCT query, ', ' ORDER BY query) AS queries, min(pos) AS pos FROM src GROUP BY url")
def source_dedup(spark, sf_dir):
    return S.merge_by_url(_found(spark, sf_dir))


@query(f"WITH {_SRC}, w AS (SELECT pos AS id, list_distinct(regexp_extract_all(lower(snippet), '[\\p{{L}}]{{4,}}')) AS w FROM src), p AS (SELECT a.id, count(*) AS n FROM w a JOIN w b ON a.id <> b.id AND len(list_intersect(a.w, b.w)) >= 3 GROUP BY a.id) SELECT w.id, coalesce(n, 0) AS n_partners, coalesce(n, 0) >= 2 AS verified FROM w LEFT JOIN p ON p.id = w.id")
def source_corroboration(spark, sf_dir):
    return S.corroborated(_found(spark, sf_dir), "pos", "snippet")


_CITE = "cite AS (SELECT event_id AS pos, event_type AS url, user_id % 5 AS section FROM events)"


def _citations(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.col("event_type").alias("url"), (F.col("user_id") % 5).alias("section"))


@query(f"WITH {_CITE}, f AS (SELECT url, row_number() OVER (ORDER BY min(pos)) AS n FROM cite GROUP BY url) SELECT pos, cite.url, section, n FROM cite JOIN f ON f.url = cite.url")
def citation_numbers(spark, sf_dir):
    return S.number_citations(_citations(spark, sf_dir))


@query(f"WITH {_CITE} SELECT section, count(*) AS citations, count(DISTINCT url) AS sources FROM cite GROUP BY section")
def citation_stats(spark, sf_dir):
    return S.statistics(_citations(spark, sf_dir))


@query(f"WITH {_CITE} SELECT url, count(*) AS times FROM cite GROUP BY url ORDER BY times DESC, min(pos) LIMIT 1")
def most_cited(spark, sf_dir):
    return S.most_cited(_citations(spark, sf_dir))


@query(f"WITH {_CITE} SELECT pos, url, section FROM cite WHERE section = 3")
def section_citations(spark, sf_dir):
    return _citations(spark, sf_dir).where("section = 3")


@query("WITH a AS (SELECT n_name AS url, n_nationkey AS pos, 'a' AS origin FROM nation WHERE n_nationkey < 15), b AS (SELECT n_name AS url, n_nationkey + 100 AS pos, 'b' AS origin FROM nation WHERE n_nationkey > 9), u AS (SELECT * FROM a UNION ALL SELECT * FROM b), f AS (SELECT url, row_number() OVER (ORDER BY min(pos)) AS n FROM u GROUP BY url) SELECT u.pos, u.url, origin, n FROM u JOIN f ON f.url = u.url")
def citation_merge(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    a = n.where("n_nationkey < 15").select(F.col("n_name").alias("url"), F.col("n_nationkey").alias("pos"), F.lit("a").alias("origin"))
    b = n.where("n_nationkey > 9").select(F.col("n_name").alias("url"), (F.col("n_nationkey") + 100).alias("pos"), F.lit("b").alias("origin"))
    return S.number_citations(a.unionByName(b))


@query(f"WITH {_SRC}, d AS (SELECT url, min_by(title, pos) AS title FROM src GROUP BY url) SELECT n, '[' || n || '] ' || title || '. ' || url AS line FROM (SELECT row_number() OVER (ORDER BY lower(title), url) AS n, title, url FROM d)")
def bibliography(spark, sf_dir):
    return S.bibliography(S.merge_by_url(_found(spark, sf_dir)))


# Small Turkish sources.
SOURCES = [
    ("https://tuik.gov.tr/a", "Pazar payı ve büyüme verisi", "Sektör oran raporu: %12 artış", 0.9, 1), ("https://x.com/b", "Genel bakış", "şirket hakkında", 0.6, 2), ("https://y.org/c", "Risk ve fırsat", "tehdit analizi", 0.8, 3),
    ("https://z.net/d", "Üretim süreci", "tedarik ve operasyon", 0.4, 4), ("https://w.edu.tr/e", "Gelir ve gider", "bütçe 5 milyon TL", 0.95, 5), ("https://v.com/f", "Rakip lider", "rekabet yoğun", 0.55, 6), ("https://u.com/g", "boş", "hiçbiri", 0.7, 7),
]
_SOURCES = f"(VALUES {value_rows(SOURCES)}) s(url, title, snippet, credibility, pos)"
_TOPIC = value_rows([(s, w) for s, ws in K.SECTION_TOPICS.items() for w in ws])


def _sources(spark):
    return spark.createDataFrame(SOURCES, "url string, title string, snippet string, credibility double, pos int")


@query(f"SELECT DISTINCT url, section FROM {_SOURCES}, (VALUES {_TOPIC}) t(section, word) WHERE contains(lower(title || ' ' || snippet), word)")
def source_sections(spark, sf_dir):
    return S.assign_sections(_sources(spark))


@query(f"""WITH d AS (SELECT DISTINCT url, section FROM {_SOURCES}, (VALUES {_TOPIC}) t(section, word) WHERE contains(lower(title || ' ' || snippet), word)),
x AS (SELECT w.section, s.url, d.url IS NOT NULL AS direct, credibility, pos FROM {_SOURCES} CROSS JOIN (VALUES ('risk_analizi'), ('finansal_projeksiyonlar')) w(section) LEFT JOIN d ON d.url = s.url AND d.section = w.section WHERE credibility >= 0.5),
r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY direct DESC, credibility DESC, pos)::INT AS rank, sum(direct::INT) OVER (PARTITION BY section) AS n FROM x)
SELECT section, url, direct, rank FROM r WHERE rank <= least(6, greatest(3, n))""")
def sources_for_section(spark, sf_dir):
    return S.for_sections(_sources(spark), ["risk_analizi", "finansal_projeksiyonlar"])


@query(rf"""SELECT url, credibility FROM {_SOURCES} WHERE regexp_matches(lower(title || ' ' || snippet), '[0-9]+[.,]?[0-9]*\s*(milyon|milyar|%|tl|usd)') OR regexp_matches(lower(title || ' ' || snippet), 'istatistik|veri|rakam|oran|rapor|araştırma')""")
def statistics_sources(spark, sf_dir):
    low = F.lower(F.concat_ws(" ", "title", "snippet"))
    return _sources(spark).where(low.rlike(r"[0-9]+[.,]?[0-9]*\s*(milyon|milyar|%|tl|usd)") | low.rlike("istatistik|veri|rakam|oran|rapor|araştırma")).orderBy(F.desc("credibility")).select("url", "credibility")


@query(f"SELECT url, credibility FROM {_SOURCES} WHERE credibility >= 0.8")
def high_credibility_sources(spark, sf_dir):
    return _sources(spark).where("credibility >= 0.8").orderBy(F.desc("credibility")).select("url", "credibility")


@query(f"""SELECT url, round(1 - CASE WHEN credibility < 0.5 THEN 0.2 ELSE 0 END - CASE WHEN pos > 5 THEN 0.1 ELSE 0 END - CASE WHEN len(list_intersect(a, b)) / len(a) < 0.3 THEN 0.3 ELSE 0 END, 6)::DOUBLE AS validity
FROM (SELECT *, list_distinct(({WORDS.format('lower(snippet)')})[:20]) AS a, list_distinct({WORDS.format("lower(title || ' ' || CASE WHEN pos % 2 = 0 THEN snippet ELSE '' END)")}) AS b FROM {_SOURCES})""")
def source_validation(spark, sf_dir):
    content = F.concat_ws(" ", "title", F.when(F.col("pos") % 2 == 0, F.col("snippet")).otherwise(""))
    v = S.validity(F.col("snippet"), content, F.col("credibility"), F.when(F.col("pos") > 5, 0.2).otherwise(1.0))
    return _sources(spark).select("url", F.round(v, 6).alias("validity"))


@query("SELECT doc_id % 10 AS claim, max(doc_id % 97) AS confidence_percent FROM documents GROUP BY doc_id % 10 HAVING max(doc_id % 97) >= 40")
def best_source(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 10).alias("claim"), F.col("doc_id").alias("source_id"), (F.col("doc_id") % 97 / 100).alias("confidence"))
    return S.best_source(d, "claim").select("claim", F.round(F.col("confidence") * 100).cast("long").alias("confidence_percent"))


_CLAIMS = " || ".join(f"regexp_extract_all(text, '(?i){p}')" for p in K.CITATION_PATTERNS)


@query(f"SELECT doc_id, len({_CLAIMS}) AS n_claims FROM documents")
def citation_claims(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(S.claims(F.col("text"))).cast("long").alias("n_claims"))


_MARK = "'\\0 [' || (doc_id % 9 + 1) || ']'"


def _marked(text: str, mark: str) -> str:
    for p in K.CITATION_PATTERNS:
        text = f"regexp_replace({text}, '(?i){p}', {mark}, 'g')"
    return text


@query(f"SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN {_marked('text', _MARK)} ELSE text END AS text FROM documents")
def citation_insert(spark, sf_dir):
    """Markers of a source after every claim, pattern by pattern."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return S.insert_citations(d, F.when(F.col("id") % 2 == 0, F.col("id") % 9 + 1))


@query(r"WITH n AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^.\n]{0,30}[0-9]+[.,]?[0-9]*\s*(?:%|TL|USD|EUR)[^.\n]{0,30}')) AS hit FROM documents) SELECT doc_id, count(*) AS hits FROM n GROUP BY doc_id")
def data_context(spark, sf_dir):
    hit = F.regexp_extract_all("text", F.lit(r"[^.\n]{0,30}[0-9]+[.,]?[0-9]*\s*(?:%|TL|USD|EUR)[^.\n]{0,30}"), F.lit(0))
    # What stands before a number is tried at every place of a text, so texts without a number and a unit are left out first.
    given = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"[0-9][.,]?\s*(?:%|TL|USD|EUR)"))
    return given.select("doc_id", F.explode(hit).alias("hit")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"))


# Report checks over small fixed reports

# Report sections.
SECTIONS = [
    (1, "yonetici_ozeti", 1, "Özet", 1, "Pazar büyüklüğü: 50 milyon TL ve hedef gelir: 10 milyon. Brüt kar: %40, net kar: %55. Büyüme: %20 beklenir. Güçlü ve lider konum."),
    (1, "pazar_analizi", 2, "Pazar", 2, "Pazar büyüklüğü: 58 milyon TL. %30 büyüme olur. | A | 50 | x\n| B | 40 |\n| C | 30 |\nYatırım tutarı: 3.000.000 ve bilindiği üzere zayıf rakipler 2010 yılında vardı."),
    (1, "finans", 3, "Finans", 4, "hedef gelir: 25 milyon. Yatırım tutarı: 3.000.000. Toplam 900 milyar TL ve 5 TL. 2036 ve 2010 yılı. 3 ay içinde başa baş."),
    (2, "kapak_sayfasi", 1, "Kapak", 1, "kısa"),
    (2, "yonetici_ozeti", 2, "Özet", 1, "Hedef: 500 müşteri [1] [2] [3]. 100 bin kişi [1]. Büyüme: %20."),
    (2, "finansal_projeksiyonlar", 3, "Finans", 1, "Brüt kar: %60 net kar: %20. Büyüme: %21. 5.000 aktif müşteri hedef. %400 büyüme ve 1 yılda pazar lideri."),
    (3, "giris", 1, "Intro", 5, ("An English text without special letters. " * 60).strip()),
]
REPORTS = [(1, "is_plani"), (2, "is_plani"), (3, "proje_raporu"), (4, "diger")]
_SEC = f"(VALUES {value_rows(SECTIONS)}) s(report_id, section_id, ord, title, level, content)"
_REP = f"(VALUES {value_rows(REPORTS)}) r(report_id, report_type)"


def _sections(spark):
    return spark.createDataFrame(SECTIONS, "report_id int, section_id string, ord int, title string, level int, content string")


def _reports(spark):
    return spark.createDataFrame(REPORTS, "report_id int, report_type string")


@query("SELECT * FROM (VALUES (1, 'pazar_buyuklugu', 'pazar_analizi', 5.8e7::DOUBLE, 5e7::DOUBLE, 'warning'), (1, 'hedef_gelir', 'finans', 2.5e7::DOUBLE, 1e7::DOUBLE, 'error'), (1, 'buyume_orani', 'pazar_analizi', 30.0::DOUBLE, 20.0::DOUBLE, 'error'), (2, 'hedef_musteri', 'finansal_projeksiyonlar', 5.0::DOUBLE, 500.0::DOUBLE, 'error')) t(report_id, metric, section_id, value, expected, severity)")
def xref_metrics(spark, sf_dir):
    return V.cross_reference(_sections(spark))


@query("SELECT 1 AS report_id, 'pazar_analizi' AS section_id, 3 AS n, 120.0::DOUBLE AS total")
def fin_percentage_sum(spark, sf_dir):
    return V.percentage_sums(_sections(spark))


@query("SELECT 1 AS report_id, 9e11::DOUBLE AS largest, 5.0::DOUBLE AS smallest")
def fin_value_spread(spark, sf_dir):
    return V.value_spread(_sections(spark))


@query(rf"""SELECT DISTINCT report_id, y AS year, CASE WHEN y < 2015 THEN 'info' ELSE 'warning' END AS severity FROM (SELECT report_id, unnest(regexp_extract_all(content, '\b(20[1-3][0-9])\b', 1))::INT AS y FROM {_SEC}) WHERE y < 2015 OR y > 2035""")
def fin_years(spark, sf_dir):
    return V.odd_years(_sections(spark))


@query("SELECT 1 AS report_id, 40.0::DOUBLE AS gross, 55.0::DOUBLE AS net")
def logic_margins(spark, sf_dir):
    return V.margins(_sections(spark))


_SAID = ", ".join(f"bool_or({' OR '.join(f'contains(lower(content), {quoted([w])})' for w in side)}) AS s{i}{j}" for i, pair in enumerate(K.CONTRADICTIONS) for j, side in enumerate(pair))


@query(f"SELECT report_id, pair FROM (SELECT report_id, unnest(list_filter([0, 1, 2, 3], lambda i: [s00 AND s01, s10 AND s11, s20 AND s21, s30 AND s31][i + 1])) AS pair FROM (SELECT report_id, {_SAID} FROM {_SEC} GROUP BY report_id))")
def logic_contradictions(spark, sf_dir):
    return V.contradictions(_sections(spark))


@query("SELECT * FROM (VALUES (1, 'finans', 'break_even'), (2, 'finansal_projeksiyonlar', 'leader'), (2, 'finansal_projeksiyonlar', 'growth')) t(report_id, section_id, issue)")
def logic_realism(spark, sf_dir):
    return _sections(spark).select("report_id", "section_id", F.explode(V.realism(F.col("content"))).alias("issue"))


_BANNED = ", ".join(f"CASE WHEN contains(lower(content), '{p}') THEN 'banned: {p}' END" for p in K.FORBIDDEN_PHRASES)
_STATS = r"regexp_extract_all(content, '%[0-9]+|[0-9]+\s*(?:milyar|milyon|bin)')"


@query(rf"""SELECT report_id, section_id, list_filter([CASE WHEN len({WORDS.format('content')}) < 500 THEN 'words' END,
  CASE WHEN len(list_filter(string_split(content, chr(10) || chr(10)), lambda p: length(trim(p)) > 50)) < 3 THEN 'paragraphs' END,
  CASE WHEN len(list_distinct(regexp_extract_all(content, '\[[0-9]+\]'))) < 3 THEN 'sources' END, {_BANNED},
  CASE WHEN len(list_filter({_STATS}, lambda s: NOT regexp_matches(substr(content, strpos(content, s), 50), '\[[0-9]+\]'))) > 0 THEN 'unsourced' END], lambda v: v IS NOT NULL) AS violations FROM {_SEC}""")
def rule_violations(spark, sf_dir):
    return _sections(spark).select("report_id", "section_id", V.rule_violations(F.col("content")).alias("violations"))


_QUALITY = r"""round(least(CASE WHEN w >= 600 THEN 0.3 WHEN w >= 300 THEN 0.2 ELSE 0.1 * w / 300 END + CASE WHEN p >= 3 THEN 0.2 ELSE 0.1 * p / 3 END + CASE WHEN r >= 3 THEN 0.2 WHEN r >= 1 THEN 0.1 ELSE 0 END
  + CASE WHEN contains(text, '|') AND contains(text, '---') THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(text, '(?m)^\s*[-•*]\s+') THEN 0.05 ELSE 0 END
  + CASE WHEN regexp_matches(text, '[0-9]+') THEN 0.075 ELSE 0 END + CASE WHEN regexp_matches(text, '%[0-9]+|[0-9]+%') THEN 0.075 ELSE 0 END, 1.0::DOUBLE), 6)"""


@query(rf"""SELECT doc_id, {_QUALITY} AS quality FROM (SELECT doc_id, text, len({WORDS.format('text')})::DOUBLE AS w, len(list_filter(string_split(text, chr(10) || chr(10)), lambda q: length(q) > 50))::DOUBLE AS p, len(list_distinct(regexp_extract_all(text, '\[([0-9]+)\]', 1))) AS r FROM documents)""")
def quality_score(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", V.quality_score(F.col("text")).alias("quality"))


@query("SELECT * FROM (VALUES (1, 'kapak_sayfasi'), (1, 'finansal_projeksiyonlar'), (3, 'kapak_sayfasi'), (3, 'yonetici_ozeti'), (3, 'sonuclar'), (4, 'kapak_sayfasi')) t(report_id, section_id)")
def missing_sections(spark, sf_dir):
    return V.missing_sections(_reports(spark), _sections(spark))


@query("SELECT report_id, errors::BIGINT AS errors, warnings::BIGINT AS warnings, infos::BIGINT AS infos, score::BIGINT AS score FROM (VALUES (1, 2, 1, 0, 55), (2, 0, 1, 0, 95), (3, 3, 1, 2, 33), (4, 1, 0, 0, 80)) t(report_id, errors, warnings, infos, score)")
def report_score(spark, sf_dir):
    return V.report_scores(_reports(spark), _sections(spark))


@query("SELECT report_id, errors::BIGINT AS errors, warnings::BIGINT AS warnings, score::BIGINT AS score, is_valid FROM (VALUES (1, 2, 1, 65, false), (2, 1, 0, 85, false)) t(report_id, errors, warnings, score, is_valid)")
def fin_score(spark, sf_dir):
    return V.issue_scores(V.cross_reference(_sections(spark)))


@query(f"SELECT report_id, count(*) AS n_sections, sum(len({WORDS.format('content')}))::BIGINT AS words, round(avg(length(content)), 6) AS mean_chars FROM {_SEC} GROUP BY report_id")
def section_statistics(spark, sf_dir):
    return _sections(spark).groupBy("report_id").agg(F.count(F.lit(1)).alias("n_sections"), F.sum(F.size(X.words(F.col("content")))).alias("words"), F.round(F.avg(F.length("content")), 6).alias("mean_chars"))

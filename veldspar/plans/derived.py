"""Queries of report checks, numbers, sources and query rewriting over texts that are made from the given tables.

A customer's orders are a report: a section for each year, whose sentences, percentages and tables state whole numbers of that year's orders.
The operators read the numbers back out of the texts; the SQL takes them from the orders, without any text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from veldspar.functions import constants as K
from veldspar.functions import numbers as N
from veldspar.functions import text as X
from veldspar.operators import rewriting as W
from veldspar.operators import sources as S
from veldspar.operators import validation as V
from veldspar.plans.chunks import _PARTS, _SYN
from veldspar.plans.registry import SQL, query, quoted, table, value_rows
from veldspar.plans.reports import _SOURCES
from veldspar.plans.scalar import WORDS
from veldspar.sources import sinks
from veldspar.sources.files import markdown_tables

#: A row for each customer and year, in words of both engines.
_YEARS = """SELECT o_custkey AS report_id, year(o_orderdate) AS ord, count(*) AS n, 10 + sum(o_orderkey % 7) AS p, 20 + max(o_orderkey % 11) AS k, 100 + min(o_orderkey % 40) AS c,
  30 + max(o_orderkey % 31) AS g, 25 + max(o_orderkey % 23) AS m, 2 * max(o_orderkey % 260) AS b, 2 + max(o_orderkey % 9000) AS v, 30 + max(o_orderkey % 9) AS x, 20 + max(o_orderkey % 17) AS y, 15 + max(o_orderkey % 29) AS z
FROM orders GROUP BY o_custkey, year(o_orderdate)"""
_SECTION = "CASE ord WHEN 1995 THEN 'kapak_sayfasi' WHEN 1996 THEN 'yonetici_ozeti' WHEN 1997 THEN 'finansal_projeksiyonlar' WHEN 1998 THEN 'sonuclar' ELSE 'yil_' || ord END"
_LINE = "chr(10)"
_CONTENT = f"""'Pazar büyüklüğü: ' || p || ' milyon TL olur. Hedef gelir: ' || k || ' milyon olur. Hedef: ' || c || ' müşteri. Brüt kar: %' || g || ' ve net kar: %' || m || ' olur; %' || b || ' büyüme beklenir, artış: ' || b || ' % olur. '
  || (3 + n) || ' ay içinde başa baş. Yıl ' || (ord + 15) || ' için toplam ' || v || ' TL. ' || CASE WHEN n % 2 = 0 THEN 'Güçlü bir konum.' ELSE 'Zayıf bir konum.' END || CASE WHEN m % 5 = 0 THEN ' Bir azalma vardır.' ELSE '' END
  || CASE WHEN m % 7 = 0 THEN ' bilindiği üzere böyledir.' ELSE '' END || {_LINE} || {_LINE} || '| Öncelik | Pay |' || {_LINE} || '|---|---|' || {_LINE} || '| A | ' || x || ' |' || {_LINE} || '| B | ' || y || ' |' || {_LINE} || '| C | ' || z || ' |'
  || {_LINE} || {_LINE} || CASE WHEN n >= 2 THEN 'Kaynaklar [1] [2] [3]' ELSE 'Kaynak [1]' END"""
_ALL = f"SELECT report_id, {_SECTION} AS section_id, ord, 'Yıl ' || ord AS title, CAST(1 + n % 5 AS INT) AS level, {_CONTENT} AS content FROM years"
_Y = f"years AS ({_YEARS})"
_S = f"{_Y}, sections AS ({_ALL})"
_TYPES = "SELECT DISTINCT o_custkey AS report_id, CASE o_custkey % 3 WHEN 0 THEN 'is_plani' WHEN 1 THEN 'proje_raporu' ELSE 'sunum' END AS report_type FROM orders"


def _sections(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return spark.sql(f"WITH {_S} SELECT * FROM sections")


def _reports(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return spark.sql(_TYPES)


_METRICS = f"""m AS (SELECT report_id, ord, {_SECTION} AS section_id, unnest(['pazar_buyuklugu', 'hedef_gelir', 'hedef_musteri', 'buyume_orani', 'basa_bas_suresi']) AS metric,
  unnest([p * 1e6, k * 1e6, c, b, 3 + n]::DOUBLE[]) AS value FROM years)"""
_APART = f"""{_METRICS}, f AS (SELECT *, first_value(value) OVER (PARTITION BY report_id, metric ORDER BY ord) AS expected FROM m),
a AS (SELECT *, CASE WHEN value = 0 AND expected = 0 THEN 0 WHEN value = 0 OR expected = 0 THEN 'inf'::DOUBLE ELSE abs(value - expected) / greatest(value, expected) END AS apart FROM f),
issues AS (SELECT report_id, metric, section_id, value, expected, CASE WHEN apart <= 0.2 THEN 'warning' ELSE 'error' END AS severity FROM a WHERE apart > 0.1)"""


@query(f"WITH {_Y}, {_METRICS} SELECT report_id, metric, section_id, value FROM m")
def report_metrics(spark, sf_dir):
    return V.metrics(_sections(spark, sf_dir)).select("report_id", "metric", "section_id", "value")


@query(f"WITH {_Y}, {_APART} SELECT * FROM issues")
def report_cross_reference(spark, sf_dir):
    return V.cross_reference(_sections(spark, sf_dir))


@query(f"""WITH {_Y}, {_APART}, n AS (SELECT report_id, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings FROM issues GROUP BY report_id)
SELECT report_id, errors, warnings, greatest(0, 100 - 15 * errors - 5 * warnings) AS score, errors = 0 AS is_valid FROM n""")
def report_issue_scores(spark, sf_dir):
    return V.issue_scores(V.cross_reference(_sections(spark, sf_dir)))


@query(f"WITH {_Y} SELECT report_id, {_SECTION} AS section_id, 3 AS n, (x + y + z)::DOUBLE AS total FROM years WHERE x + y + z > 105")
def report_percentage_sums(spark, sf_dir):
    return V.percentage_sums(_sections(spark, sf_dir))


@query(f"""WITH {_Y}, r AS (SELECT report_id, greatest(max(p) * 1e6, max(v))::DOUBLE AS largest, least(min(p) * 1e6, min(v))::DOUBLE AS smallest FROM years GROUP BY report_id)
SELECT * FROM r WHERE smallest > 1 AND largest > 10000 * smallest""")
def report_value_spread(spark, sf_dir):
    return V.value_spread(_sections(spark, sf_dir))


@query(f"WITH {_Y} SELECT DISTINCT report_id, (ord + 15)::INT AS year, 'info' AS severity FROM years WHERE ord + 15 BETWEEN 2010 AND 2014")
def report_odd_years(spark, sf_dir):
    return V.odd_years(_sections(spark, sf_dir))


@query(f"WITH {_Y} SELECT report_id, {_SECTION} AS section_id, b::DOUBLE AS value, CASE WHEN b > 500 THEN 'error' ELSE 'warning' END AS severity FROM years WHERE b > 200")
def report_growth_rates(spark, sf_dir):
    return V.growth_rates(_sections(spark, sf_dir))


_FIRST = "r AS (SELECT report_id, arg_min(g, ord)::DOUBLE AS gross, arg_min(m, ord)::DOUBLE AS net FROM years GROUP BY report_id)"


@query(f"WITH {_Y}, {_FIRST} SELECT report_id, gross, net FROM r WHERE net > gross")
def report_margins(spark, sf_dir):
    return V.margins(_sections(spark, sf_dir))


@query(f"""WITH {_Y}, {_FIRST}, x AS (SELECT report_id, 'gross_margin' AS ratio, gross AS value, 20.0::DOUBLE AS low, 50.0::DOUBLE AS high FROM r UNION ALL SELECT report_id, 'net_margin', net, 3.0, 15.0 FROM r) SELECT * FROM x WHERE value < low OR value > high""")
def report_unusual_margins(spark, sf_dir):
    """Margins outside of what is usual in manufacturing."""
    return V.margins_out_of_range(_sections(spark, sf_dir), "uretim")


@query(f"""WITH {_Y}, r AS (SELECT report_id, bool_or(m % 5 = 0) AS falls, count(DISTINCT n % 2) AS sides FROM years GROUP BY report_id)
SELECT report_id, 0 AS pair FROM r WHERE falls UNION ALL SELECT report_id, 1 FROM r WHERE sides = 2""")
def report_contradictions(spark, sf_dir):
    return V.contradictions(_sections(spark, sf_dir))


@query(f"WITH {_Y} SELECT report_id, 'pazar_buyuklugu' AS metric, list_sort(list(DISTINCT p::DOUBLE)) AS \"values\" FROM years GROUP BY report_id HAVING count(DISTINCT p) > 1")
def report_disagreements(spark, sf_dir):
    return V.disagreements(_sections(spark, sf_dir))


@query(f"WITH {_Y}, i AS (SELECT report_id, {_SECTION} AS section_id, unnest([CASE WHEN b > 300 THEN 'growth' END, CASE WHEN 3 + n <= 6 THEN 'break_even' END]) AS issue FROM years) SELECT * FROM i WHERE issue IS NOT NULL")
def report_realism(spark, sf_dir):
    return _sections(spark, sf_dir).select("report_id", "section_id", F.explode(V.realism(F.col("content"))).alias("issue"))


@query(f"""WITH {_Y} SELECT report_id, {_SECTION} AS section_id, list_filter(['words', 'paragraphs', CASE WHEN n < 2 THEN 'sources' END, CASE WHEN m % 7 = 0 THEN 'banned: bilindiği üzere' END, 'unsourced'], lambda v: v IS NOT NULL) AS violations FROM years""")
def report_rules(spark, sf_dir):
    return _sections(spark, sf_dir).select("report_id", "section_id", V.rule_violations(F.col("content")).alias("violations"))


_NEEDED = f"""t AS ({_TYPES}), w AS (SELECT report_id, unnest(['kapak_sayfasi'] || CASE report_type WHEN 'is_plani' THEN ['yonetici_ozeti', 'finansal_projeksiyonlar'] WHEN 'proje_raporu' THEN ['yonetici_ozeti', 'sonuclar'] ELSE [] END) AS section_id FROM t),
missing AS (SELECT * FROM w EXCEPT SELECT report_id, {_SECTION} FROM years)"""


@query(f"WITH {_Y}, {_NEEDED} SELECT * FROM missing")
def report_missing_sections(spark, sf_dir):
    return V.missing_sections(_reports(spark, sf_dir), _sections(spark, sf_dir))


@query(f"""WITH {_Y}, {_NEEDED}, u AS (SELECT report_id, 0 AS e, (1 + n % 5 > 3)::INT AS w FROM years UNION ALL SELECT report_id, 1, 0 FROM missing),
s AS (SELECT report_id, sum(e)::BIGINT AS errors, sum(w)::BIGINT AS warnings, 0::BIGINT AS infos FROM u GROUP BY report_id) SELECT *, greatest(0, 100 - 20 * errors - 5 * warnings) AS score FROM s""")
def report_scores(spark, sf_dir):
    return V.report_scores(_reports(spark, sf_dir), _sections(spark, sf_dir))


@query(f"WITH {_S} SELECT report_id, count(*) AS n_sections, sum(len({WORDS.format('content')}))::BIGINT AS words, round(avg(length(content)), 6) AS mean_chars FROM sections GROUP BY report_id")
def report_statistics(spark, sf_dir):
    return _sections(spark, sf_dir).groupBy("report_id").agg(F.count(F.lit(1)).alias("n_sections"), F.sum(F.size(X.words(F.col("content")))).alias("words"), F.round(F.avg(F.length("content")), 6).alias("mean_chars"))


@query(f"""WITH {_S}, n AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY ord) AS i FROM sections)
SELECT report_id, sha256(string_agg(repeat('#', level) || ' ' || i || '. ' || title || chr(10) || chr(10) || content, chr(10) || chr(10) ORDER BY ord)) AS digest FROM n GROUP BY report_id""")
def report_markdown(spark, sf_dir):
    return sinks.markdown_report(_sections(spark, sf_dir)).select("report_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query(f"""WITH {_S} SELECT report_id, len(json) AS n_sections, json[1].section_id AS first_section, json[-1].level AS last_level FROM
(SELECT report_id, list({{'section_id': section_id, 'level': level}} ORDER BY ord) AS json FROM sections GROUP BY report_id)""")
def report_json(spark, sf_dir):
    """JSON reports, read back."""
    made = sinks.json_report(_sections(spark, sf_dir))
    x = made.select("report_id", F.from_json("json", "array<struct<section_id string, level int, content string>>").alias("s"))
    return x.select("report_id", F.size("s").cast("long").alias("n_sections"), F.element_at("s", 1)["section_id"].alias("first_section"), F.element_at("s", -1)["level"].alias("last_level"))


@query(f"WITH {_Y} SELECT report_id, ord, 0 AS \"table\", ['Öncelik', 'Pay'] AS headers, 'A;' || x || '|B;' || y || '|C;' || z AS cells FROM years")
def report_tables(spark, sf_dir):
    """Markdown tables found in the sections."""
    texts = _sections(spark, sf_dir).select((F.col("report_id") * 10_000 + F.col("ord")).alias("doc_id"), F.col("content").alias("text"))
    cells = F.array_join(F.transform("rows", lambda r: F.array_join(r, ";")), "|")
    return markdown_tables(texts).select(F.floor(F.col("doc_id") / 10_000).alias("report_id"), (F.col("doc_id") % 10_000).alias("ord"), "table", "headers", cells.alias("cells"))


@query(f"WITH {_Y} SELECT report_id * 10000 + ord AS doc_id, CASE WHEN x + y + z <= 100 THEN 'pie' ELSE 'bar' END AS kind, ['A', 'B', 'C'] AS labels, [x, y, z]::DOUBLE[] AS \"values\" FROM years")
def report_charts(spark, sf_dir):
    """The data of a chart for each section."""
    return W.chart_data(_sections(spark, sf_dir).select((F.col("report_id") * 10_000 + F.col("ord")).alias("doc_id"), F.col("content").alias("text")))


@query(f"""WITH {_Y}, {_APART}, l AS (SELECT report_id, metric, string_agg('  - ' || section_id || ': ' || format('{{:,.2f}}', value), chr(10) ORDER BY ord, section_id) AS lines FROM m GROUP BY ALL),
k AS (SELECT report_id, string_agg(metric || ':' || chr(10) || lines, chr(10) || chr(10) ORDER BY metric) AS known FROM l GROUP BY report_id),
o AS (SELECT report_id, severity || ': ' || metric || ' ' || section_id || ' ' || format('{{:,.2f}}', value) || ' / ' || format('{{:,.2f}}', expected) AS line FROM issues), x AS (SELECT report_id, string_agg(line, chr(10) ORDER BY line) AS odd FROM o GROUP BY report_id)
SELECT k.report_id, sha256(concat_ws(chr(10) || chr(10), known, odd)) AS digest FROM k LEFT JOIN x ON x.report_id = k.report_id""")
def report_consistency(spark, sf_dir):
    """The consistency report of each report: all metrics by section, then what differs."""
    return V.consistency_report(_sections(spark, sf_dir)).select("report_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


# Numbers

@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 4 THEN -round(o_totalprice, 2) WHEN 5 THEN (o_custkey || '.5')::DOUBLE * 1e6 ELSE round(o_totalprice, 2) END AS parsed,
  CASE WHEN o_orderkey % 6 = 5 THEN 'multiplied' WHEN o_orderkey % 6 = 2 THEN 'simple' WHEN o_totalprice < 1000 AND o_orderkey % 6 = 1 THEN 'simple' WHEN o_totalprice < 1000 THEN 'decimal_comma' WHEN o_orderkey % 6 = 1 THEN 'us' ELSE 'turkish' END AS form FROM orders""")
def price_spellings(spark, sf_dir):
    """Prices in six spellings, parsed back, with the spelling that was seen."""
    price = F.col("o_totalprice")
    turkish, us, plain = N.format_turkish(price), F.format_number(price, 2), F.format_string("%.2f", price)
    raw = F.array(turkish, us, plain, F.concat(F.lit("₺"), turkish), F.concat(F.lit(" ("), turkish, F.lit(") ")), F.concat(F.col("o_custkey").cast("string"), F.lit(",5 milyon")))
    x = table(spark, sf_dir, "orders").select("o_orderkey", F.get(raw, (F.col("o_orderkey") % 6).cast("int")).alias("raw"))
    return x.select("o_orderkey", N.parse_number(F.col("raw")).alias("parsed"), N.number_format(F.col("raw")).alias("form"))


# Sources

_HOST = "split_part(replace(regexp_replace(url, '^https?://', ''), 'www.', ''), '/', 1)"


@query(f"""SELECT page_id, {_HOST} AS domain, coalesce((SELECT arg_max(score, length(suffix)) FROM (VALUES {value_rows([(k, float(v)) for k, v in K.CREDIBILITY.items()])}) t(suffix, score) WHERE {_HOST} = suffix OR ends_with({_HOST}, '.' || suffix)), 0.5) AS credibility FROM pages""")
def page_credibility(spark, sf_dir):
    host = N.domain(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", host.alias("domain"), N.credibility(host).alias("credibility"))


# Every part is a source: its title and snippet take turns among wordings, with numbers of the part.
_PART_SOURCES = """(SELECT 'https://site' || (p_partkey % 50) || '.org/' || p_partkey AS url,
  CASE p_partkey % 5 WHEN 0 THEN 'Pazar payı ve büyüme verisi' WHEN 1 THEN 'Genel bakış' WHEN 2 THEN 'Risk ve fırsat' WHEN 3 THEN 'Gelir ve gider' ELSE 'Üretim süreci' END AS title,
  CASE p_partkey % 4 WHEN 0 THEN 'Sektör raporu: %' || p_size || ' artış' WHEN 1 THEN 'bütçe ' || p_size || ' milyon TL ' || p_name WHEN 2 THEN 'tehdit analizi ' || p_brand ELSE 'şirket hakkında ' || p_type END AS snippet,
  CAST(p_partkey % 20 AS DOUBLE) / 20 AS credibility, CAST(p_partkey % 9 AS INT) AS pos FROM part) s"""
_SECTIONS_ASKED = ["risk_analizi", "finansal_projeksiyonlar"]


def _of_parts(name: str) -> str:
    """The SQL of a query over sources, over parts."""
    return SQL[name].replace(_SOURCES, _PART_SOURCES)


def _part_sources(spark, sf_dir):
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    return spark.sql(f"SELECT * FROM {_PART_SOURCES}")


@query(_of_parts("source_sections"))
def part_source_sections(spark, sf_dir):
    return S.assign_sections(_part_sources(spark, sf_dir))


@query(_of_parts("sources_for_section").replace("credibility DESC, pos)", "credibility DESC, pos, s_url)").replace("SELECT w.section, s.url,", "SELECT w.section, s.url AS s_url, s.url,"))
def part_sources_for_section(spark, sf_dir):
    rows = _part_sources(spark, sf_dir)
    return S.for_sections(rows.withColumn("pos", F.struct("pos", "url")), _SECTIONS_ASKED)


@query(_of_parts("statistics_sources"))
def part_statistics_sources(spark, sf_dir):
    low = F.lower(F.concat_ws(" ", "title", "snippet"))
    return _part_sources(spark, sf_dir).where(low.rlike(r"[0-9]+[.,]?[0-9]*\s*(milyon|milyar|%|tl|usd)") | low.rlike("istatistik|veri|rakam|oran|rapor|araştırma")).select("url", "credibility")


@query(_of_parts("high_credibility_sources"))
def part_credible_sources(spark, sf_dir):
    return _part_sources(spark, sf_dir).where("credibility >= 0.8").select("url", "credibility")


@query(_of_parts("source_validation"))
def part_source_validation(spark, sf_dir):
    content = F.concat_ws(" ", "title", F.when(F.col("pos") % 2 == 0, F.col("snippet")).otherwise(""))
    v = S.validity(F.col("snippet"), content, F.col("credibility"), F.when(F.col("pos") > 5, 0.2).otherwise(1.0))
    return _part_sources(spark, sf_dir).select("url", F.round(v, 6).alias("validity"))


# Query rewriting

_BENCHMARK = "(SELECT item_id AS query_id, text FROM benchmark)"


def _asks(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"SELECT query_id, CASE WHEN len({WORDS.format('text')}) > 10 THEN 'decomposition' WHEN len({WORDS.format('text')}) < 4 THEN 'expansion' ELSE 'expansion' END AS strategy FROM {_BENCHMARK}")
def benchmark_strategy(spark, sf_dir):
    return _asks(spark, sf_dir).select("query_id", W.strategy(F.col("text")).alias("strategy"))


@query(f"SELECT query_id, trim(p) AS part FROM (SELECT query_id, text, unnest({_PARTS}) AS p, len({_PARTS}) AS n FROM {_BENCHMARK}) WHERE n = 1 OR length(trim(p)) > 5")
def benchmark_parts(spark, sf_dir):
    return _asks(spark, sf_dir).select("query_id", F.explode(W.decompose(F.col("text"))).alias("part"))


@query(f"""WITH a AS (SELECT query_id * 1000 + i AS query_id, w AS text FROM (SELECT section_id AS query_id, 0 AS i, title AS w FROM (SELECT report_id AS section_id, 'pazar analizi ve gelir ' || ord AS title FROM ({_YEARS})))),
e AS (SELECT query_id, 0 AS ord, text AS variant FROM a UNION ALL SELECT query_id, ord + 1, replace(lower(text), head, word) FROM a, (VALUES {_SYN}) s(ord, head, word) WHERE contains(lower(text), head)),
d AS (SELECT query_id, variant, min(ord) AS ord FROM e GROUP BY ALL), r AS (SELECT query_id, variant, row_number() OVER (PARTITION BY query_id, right(variant, 4) ORDER BY ord)::INT AS n FROM d)
SELECT query_id, variant, n FROM r WHERE n <= 5""")
def report_query_variants(spark, sf_dir):
    """Search phrases for each year of each customer's report, with synonyms put in."""
    asks = _sections(spark, sf_dir).select((F.col("report_id") * 1000).alias("query_id"), F.concat(F.lit("pazar analizi ve gelir "), F.col("ord")).alias("text"))
    return W.expand(asks)


_LINES = "(SELECT item_id AS query_id, trim(replace(text, chr(10), ' ')) AS text FROM benchmark)"


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.trim(F.replace("text", F.lit("\n"), F.lit(" "))).alias("text"))


def reworded(prompts: list[str]) -> list[str]:
    """A provider that answers with the prompt's last line in three ways, and a blank line between."""
    last = [p.rpartition("\n")[2].partition(": ")[2] for p in prompts]
    return [f"{x} what\n\n{x} why\n{x} where" for x in last]


@query(f"SELECT query_id, text, text || ' what' || chr(10) || chr(10) || text || ' why' || chr(10) || text || ' where' AS variant FROM {_LINES}")
def benchmark_hypothetical(spark, sf_dir):
    """An ideal answer to each item, to search with."""
    return W.hypothetical(_lines(spark, sf_dir), reworded)


@query(f"SELECT query_id, text AS variant, 1 AS n FROM {_LINES} UNION ALL SELECT query_id, text || ' what', 2 FROM {_LINES} UNION ALL SELECT query_id, text || ' why', 3 FROM {_LINES}")
def benchmark_rewordings(spark, sf_dir):
    return W.multiple(_lines(spark, sf_dir), reworded)


@query("SELECT doc_id, CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(text), {quoted([w])})' for w in ws)} THEN '{name}'" for name, ws in K.SECTORS.items()) + " END AS sector FROM documents")
def document_sectors(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", W.sector(F.col("text")).alias("sector"))

"""Queries of text, number and row-check functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.functions import constants as K
from veldspar.functions import numbers as N
from veldspar.functions import text as X
from veldspar.plans.registry import query, quoted, table, value_rows

_LETTERS_ONLY = r"regexp_replace(lower(text), '[^a-zçğıöşü\s]', ' ', 'g')"
WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"


def _hits(keywords: list[str], text: str) -> str:
    return "(" + " + ".join(f"contains({text}, '{k}')::INT" for k in keywords) + ")"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


_CLEAN = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({_CLEAN}) AS digest, length({_CLEAN}) AS chars FROM documents")
def clean_text(spark, sf_dir):
    c = X.clean_text(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.md5(c.cast("binary")).alias("digest"), F.length(c).cast("long").alias("chars"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(9), ' '), ' +', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM documents")
def normalize_whitespace(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(X.normalize_whitespace(F.col("text")).cast("binary")).alias("digest"))


@query("SELECT doc_id, CASE WHEN length(text) <= 60 THEN text ELSE text[:57] || '...' END AS short FROM documents")
def truncate_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.truncate_text(F.col("text"), 60).alias("short"))


@query("""
WITH h AS (SELECT doc_id, text, text[:77] AS head FROM documents), l AS (SELECT *, length(head) - strpos(reverse(head), ' ') AS last FROM h)
SELECT doc_id, CASE WHEN length(text) <= 80 THEN text WHEN contains(head, ' ') AND last > 40 THEN head[:last] || '...' ELSE head || '...' END AS short FROM l""")
def truncate_safe(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.truncate_safe(F.col("text"), 80).alias("short"))


@query(r"""
SELECT doc_id, CASE WHEN regexp_matches(text, '^[^.!?]*[.!?]') THEN regexp_extract(text, '^[^.!?]*[.!?]') WHEN length(text) <= 200 THEN text ELSE text[:197] || '...' END AS first FROM documents""")
def first_sentence(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.first_sentence(F.col("text")).alias("first"))


@query(rf"""
SELECT doc_id, len({WORDS.format('text')}) AS n_words, len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: length(trim(p)) >= 50)) AS n_paragraphs FROM documents""")
def word_counts(spark, sf_dir):
    c = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", F.size(X.words(c)).cast("long").alias("n_words"), F.size(X.paragraphs(c)).cast("long").alias("n_paragraphs"))


_SENTENCES = r"string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"


@query(f"""
WITH s AS (SELECT doc_id, list_filter(list_transform({_SENTENCES}, lambda x: trim(x)), lambda x: length(x) >= 20) AS s FROM documents)
SELECT doc_id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS sentence FROM s""")
def sentences(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))


@query(rf"""
SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])\s+([A-Za-zçğıöşüÇĞİÖŞÜ])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x) <> '')) AS n_sentences FROM documents""")
def sentences_before_letters(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(X.sentences_before_letters(F.col("text"))).cast("long").alias("n_sentences"))


@query(rf"""
SELECT doc_id, len(t) AS n_tokens, list_sort(list_distinct(t))[:5] AS first_terms
FROM (SELECT doc_id, list_filter({WORDS.format(_LETTERS_ONLY)}, lambda w: length(w) >= 2) AS t FROM documents)""")
def tokenize_letters(spark, sf_dir):
    t = F.filter(X.keyword_words(F.col("text")), lambda w: F.length(w) >= 2)
    return _docs(spark, sf_dir).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.slice(F.array_sort(F.array_distinct(t)), 1, 5).alias("first_terms"))


@query(rf"""
SELECT doc_id, len({WORDS.format('text')}) - len(list_filter({WORDS.format('lower(text)')}, lambda w: w IN ({quoted(K.STOP_KEYWORDS)}))) AS n_kept FROM documents""")
def remove_stop_words(spark, sf_dir):
    kept = F.filter(X.lower_words(F.col("text")), lambda w: ~w.isin(K.STOP_KEYWORDS))
    return _docs(spark, sf_dir).select("doc_id", F.size(kept).cast("long").alias("n_kept"))


def _stem_sql(word: str, suffixes: list[str], least: int) -> str:
    return "CASE " + " ".join(f"WHEN length({word}) > {len(s) + least} AND ends_with({word}, '{s}') THEN left({word}, length({word}) - {len(s)})" for s in suffixes) + f" ELSE {word} END"


_STEMMED = "SELECT DISTINCT unnest(" + WORDS.format(r"regexp_replace(lower(text), '[^\p{L}\s]', ' ', 'g')") + ") AS word FROM documents"


@query(f"""
SELECT word, {_stem_sql('word', K.SUFFIXES_LEXICAL, 2)} AS lexical, {_stem_sql('word', K.SUFFIXES_TOKENIZER, 3)} AS tokenizer, {_stem_sql('word', X.longest_first(K.SUFFIXES_KEYWORDS), 2)} AS keyword FROM ({_STEMMED})""")
def stems(spark, sf_dir):
    w = _docs(spark, sf_dir).select(F.explode(X.words(F.regexp_replace(F.lower("text"), r"[^\p{L}\s]", " "))).alias("word")).distinct()
    c = F.col("word")
    return w.select("word", X.stem_first(c, K.SUFFIXES_LEXICAL, 2).alias("lexical"), X.stem_first(c, K.SUFFIXES_TOKENIZER, 3).alias("tokenizer"), X.stem_first(c, X.longest_first(K.SUFFIXES_KEYWORDS), 2).alias("keyword"))


_COUNT = "(length(text) - length(replace(text, '{0}', '')))"


@query(rf"""
SELECT doc_id, CASE WHEN {_COUNT.format('|')} >= 3 THEN 'table' WHEN regexp_matches(text, '(?m)^\s*[-*•]\s') THEN 'list'
  WHEN contains(text, '```') OR {_COUNT.format('    ')} >= 12 THEN 'code' ELSE 'text' END AS content_type,
  regexp_matches(text, '[0-9]') AS has_numbers, regexp_matches(text, '[0-9]{{4}}') AS has_dates, regexp_matches(text, '[₺$€]|TL|USD|EUR') AS has_currency FROM documents""")
def chunk_flags(spark, sf_dir):
    c = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", X.content_type(c).alias("content_type"), c.rlike("[0-9]").alias("has_numbers"), c.rlike("[0-9]{4}").alias("has_dates"), c.rlike("[₺$€]|TL|USD|EUR").alias("has_currency"))


def _best_sql(scores: list[tuple[str, str]], none: str) -> str:
    """The first name with the largest positive score."""
    largest = f"greatest({', '.join(s for _, s in scores)})"
    return f"CASE WHEN {largest} = 0 THEN {none} " + " ".join(f"WHEN {s} = {largest} THEN '{n}'" for n, s in scores) + " END"


_CATS = [(n, f"({_hits(k, 'low')} / {len(k)}.0::DOUBLE * {w}::DOUBLE)") for n, (w, k) in K.CATEGORIES.items()]
_CAT_SQL = f"""SELECT doc_id, low, {_best_sql(_CATS, "'genel'")} AS category, CASE WHEN greatest({', '.join(s for _, s in _CATS)}) = 0 THEN 0.5::DOUBLE ELSE least(greatest({', '.join(s for _, s in _CATS)}) * 2, 1.0::DOUBLE) END AS confidence FROM (SELECT doc_id, lower(text) AS low FROM documents)"""


@query(f"SELECT doc_id, category, round(confidence, 9) AS confidence FROM ({_CAT_SQL})")
def doc_category(spark, sf_dir):
    c = X.category(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", c.alias("c")).select("doc_id", F.col("c.name").alias("category"), F.round("c.confidence", 9).alias("confidence"))


_SUB = " ".join(f"WHEN category = '{n}' THEN {_best_sql([(k, _hits(v, 'low')) for k, v in subs.items()], 'NULL')}" for n, subs in K.SUBCATEGORIES.items())


@query(f"SELECT doc_id, category, CASE {_SUB} END AS subcategory, {_best_sql([(n, _hits(k, 'low')) for n, k in K.CHUNK_CATEGORIES.items()], 'NULL')} AS chunk_category FROM ({_CAT_SQL})")
def doc_subcategory(spark, sf_dir):
    x = _docs(spark, sf_dir).withColumn("category", X.category(F.col("text"))["name"])
    return x.select("doc_id", "category", X.subcategory(F.col("text"), F.col("category")).alias("subcategory"), X.chunk_category(F.col("text")).alias("chunk_category"))


def _entity_sql(kind: str) -> str:
    found = " || ".join("regexp_extract_all(text, '(?i)" + p + "')" for p in K.ENTITY_PATTERNS[kind])
    return f"array_to_string(list_sort(list_distinct({found}))[:10], '; ') AS {kind}"


@query(f"SELECT doc_id, {', '.join(map(_entity_sql, K.ENTITY_PATTERNS))} FROM documents")
def doc_entities(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", *(F.array_join(X.entities(F.col("text"), k), "; ").alias(k) for k in K.ENTITY_PATTERNS))


_TR = _hits([f" {w} " for w in ("ve", "bir", "için", "ile", "bu", "da", "de")], "lower(s)")


@query(rf"""
WITH s AS (SELECT doc_id, text[:1000] AS s FROM documents),
n AS (SELECT *, length(regexp_replace(s, '[^\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(s, '[^çğıöşüÇĞİÖŞÜ]', '', 'g')) AS tr FROM s)
SELECT doc_id, CASE WHEN letters > 0 AND tr / letters > 0.01 THEN 'tr' WHEN {_TR} >= 3 THEN 'tr' ELSE 'en' END AS language FROM n""")
def doc_language(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.is_turkish(F.col("text")).alias("language"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^#+\s*', '', 'g'), '\*\*', '', 'g'), '\[[0-9]+\]', '', 'g')) AS digest FROM documents")
def plain_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(X.plain_text(F.col("text")).cast("binary")).alias("digest"))


_INJECTION = "|".join(f"(?:{p})" for p in K.INJECTION_PATTERNS)


@query(f"SELECT conv_id, turn, coalesce(regexp_matches(text, '(?i){_INJECTION}'), false) AS flagged FROM conversations")
def injection_flags(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(X.contains_injection(F.col("text")), F.lit(False)).alias("flagged"))


def _sanitize_sql(c: str) -> str:
    for p in K.INJECTION_PATTERNS:
        c = f"regexp_replace({c}, '(?i){p}', '[FILTERED]', 'g')"
    return f"replace(replace(replace({c}, '```', ''''''''), '<script', '&lt;script'), '</script>', '&lt;/script&gt;')"


@query(f"SELECT conv_id, turn, md5({_sanitize_sql('text')}) AS digest FROM conversations WHERE text IS NOT NULL")
def sanitize_prompt(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.md5(X.sanitize_prompt(F.col("text")).cast("binary")).alias("digest"))


_HTML = "regexp_replace(html, '<[^>]+>', '', 'g')"
for _e, _m in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"')):
    _HTML = f"replace({_HTML}, '{_e}', '{_m}')"


@query(f"SELECT page_id, md5({_HTML}) AS digest, length({_HTML}) AS chars FROM pages")
def html_sanitize(spark, sf_dir):
    c = X.sanitize_html(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(c.cast("binary")).alias("digest"), F.length(c).cast("long").alias("chars"))


_TOKENS = rf"CASE WHEN length(text) = 0 THEN 0 ELSE greatest(trunc(len({WORDS.format('text')}) * 1.5::DOUBLE), trunc(length(text) / 3.5::DOUBLE))::INT END"


@query(f"SELECT doc_id, {_TOKENS} AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT doc_id, md5(lower(text)) AS md5_hex, sha256(text) AS sha256_hex, md5(source || ':' || lang) AS cache_key FROM documents")
def text_hash(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(F.lower("text").cast("binary")).alias("md5_hex"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256_hex"), F.md5(F.concat_ws(":", "source", "lang").cast("binary")).alias("cache_key"))


_EMBED = ", ".join(f"('0x' || h[{2 * i + 1}:{2 * i + 2}])::INT / 255::DOUBLE" for i in range(32))


@query(f"SELECT doc_id, [{_EMBED}] AS embedding FROM (SELECT doc_id, sha256(text) AS h FROM documents)")
def hash_embedding(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.hash_embedding(F.col("text")).alias("embedding"))


# Number spellings and what they parse to.
NUMBERS = [
    ("1.234,56", 1234.56), ("1,234.56", 1234.56), ("12345", 12345.0), ("  1.234,56  ", 1234.56), ("not a number", None), ("1.234", 1.234), ("1,234", 1.234), ("1.234.567", 1234567.0),
    ("1,234,567", 1234567.0), ("(123)", -123.0), ("1,5 milyon", 1.5e6), ("2 milyar", 2e9), ("3k", 3000.0), ("%25", 25.0), ("₺1.234,56", 1234.56), ("1234,5", 1234.5), ("-7.25", -7.25), ("1.234,5 milyon", None), ("", None),
]


@query(f"SELECT * FROM (VALUES {value_rows(NUMBERS)}) t(raw, parsed)")
def number_parse(spark, sf_dir):
    return spark.createDataFrame(NUMBERS, "raw string, expected double").select("raw", N.parse_number(F.col("raw")).alias("parsed"))


@query(f"""
WITH c AS (SELECT raw, trim(regexp_replace(trim(raw), '[₺$€£¥%]', '', 'g')) AS c0 FROM (VALUES {value_rows(NUMBERS)}) t(raw, parsed)),
d AS (SELECT raw, CASE WHEN starts_with(c0, '(') AND ends_with(c0, ')') THEN '-' || c0[2:-2] ELSE c0 END AS c FROM c)
SELECT raw, CASE WHEN regexp_matches(lower(c), '{N.SCALED}') THEN 'multiplied' WHEN regexp_matches(c, '{N.TURKISH}') THEN 'turkish' WHEN regexp_matches(c, '{N.US}') THEN 'us'
  WHEN regexp_matches(c, '{N.COMMA}') THEN 'decimal_comma' WHEN regexp_matches(c, '{N.PLAIN}') THEN 'simple' ELSE 'unknown' END AS form FROM d""")
def number_detect(spark, sf_dir):
    return spark.createDataFrame(NUMBERS, "raw string, expected double").select("raw", N.number_format(F.col("raw")).alias("form"))


@query("SELECT o_orderkey, translate(format('{:,.2f}', o_totalprice), ',.', '.,') AS price FROM orders")
def number_format_tr(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", N.format_turkish(F.col("o_totalprice")).alias("price"))


@query(r"""
WITH n AS (SELECT doc_id, unnest(regexp_extract_all(text, '-?[0-9]{1,3}(?:[.,][0-9]{3})*[.,][0-9]+|-?[0-9]{1,3}(?:[.,][0-9]{3})+|-?[0-9]+[.,][0-9]+|-?[0-9]+')) AS raw FROM documents)
SELECT doc_id, count(*) AS n_numbers, min(raw) AS first_raw, max(length(raw)) AS longest FROM n GROUP BY doc_id""")
def number_spans(spark, sf_dir):
    found = F.regexp_extract_all("text", F.lit(r"-?[0-9]{1,3}(?:[.,][0-9]{3})*[.,][0-9]+|-?[0-9]{1,3}(?:[.,][0-9]{3})+|-?[0-9]+[.,][0-9]+|-?[0-9]+"), F.lit(0))
    x = _docs(spark, sf_dir).select("doc_id", F.explode(found).alias("raw"))
    return x.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_numbers"), F.min("raw").alias("first_raw"), F.max(F.length("raw")).cast("long").alias("longest"))


_PLAIN_NUMBER = r"-?[0-9]{1,3}(?:[.,][0-9]{3})*[.,][0-9]+|-?[0-9]{1,3}(?:[.,][0-9]{3})+|-?[0-9]+[.,][0-9]+|-?[0-9]+"
_SIMPLE = f"""CASE WHEN regexp_matches(r, '{N.TURKISH}') THEN replace(replace(r, '.', ''), ',', '.')::DOUBLE WHEN regexp_matches(r, '{N.US}') THEN replace(r, ',', '')::DOUBLE
  WHEN regexp_matches(r, '{N.WHOLE_TURKISH}') THEN replace(r, '.', '')::DOUBLE WHEN regexp_matches(r, '{N.WHOLE_US}') THEN replace(r, ',', '')::DOUBLE WHEN regexp_matches(r, '{N.COMMA}') THEN replace(r, ',', '.')::DOUBLE
  WHEN regexp_matches(r, '{N.PLAIN}') THEN r::DOUBLE ELSE TRY_CAST(regexp_replace(r, '[., ]', '', 'g') AS DOUBLE) END"""
_SCALE = "CASE " + " ".join(f"WHEN u = '{u}' THEN {m!r}::DOUBLE" for u, m in K.MULTIPLIERS.items()) + " END"
_SCALED_NUMBER = rf"(?i)-?[0-9]+(?:[.,][0-9]+)?\s*(?:{N._UNITS})\b"


@query(rf"""WITH a AS (SELECT doc_id, 0 AS kind, generate_subscripts(x, 1) AS i, lower(unnest(x)) AS r FROM (SELECT doc_id, regexp_extract_all(text, '{_SCALED_NUMBER}') AS x FROM documents)),
s AS (SELECT doc_id, kind, i, replace(regexp_extract(r, '^(-?[0-9]+(?:[.,][0-9]+)?)', 1), ',', '.')::DOUBLE * {_SCALE} AS v FROM (SELECT *, regexp_extract(r, '({N._UNITS})$', 1) AS u FROM a)),
b AS (SELECT doc_id, 1 AS kind, generate_subscripts(x, 1) AS i, unnest(x) AS r FROM (SELECT doc_id, regexp_extract_all(text, '{_PLAIN_NUMBER}') AS x FROM documents)),
u AS (SELECT * FROM s UNION ALL SELECT doc_id, kind, i, {_SIMPLE} FROM b), f AS (SELECT doc_id, v, min(kind * 1000000 + i) AS o FROM u GROUP BY doc_id, v)
SELECT doc_id, list(v ORDER BY o) AS numbers FROM f GROUP BY doc_id""")
def extract_numbers(spark, sf_dir):
    """All parsed numbers of a text, those with a unit first."""
    return _docs(spark, sf_dir).select("doc_id", N.extract_numbers(F.col("text")).alias("numbers")).where(F.size("numbers") > 0)


@query(r"""
SELECT o_orderkey, '%' || printf('%.1f', o_totalprice / 10000) AS percent, printf('%.2f', o_totalprice) || ' ₺' AS money,
  CASE WHEN o_custkey % 5 = 0 THEN -1.0::DOUBLE ELSE o_totalprice / (o_custkey % 5) END AS quotient FROM orders""")
def format_values(spark, sf_dir):
    c = F.col("o_totalprice")
    quotient = F.coalesce(F.try_divide(c, F.col("o_custkey") % 5), F.lit(-1.0))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("%"), N.fixed(c / 10000, 1)).alias("percent"), F.concat(N.fixed(c, 2), F.lit(" ₺")).alias("money"), quotient.alias("quotient"))


@query("""
SELECT page_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f', b / 1024.0) || ' KB' ELSE printf('%.1f', b / 1048576.0) || ' MB' END AS size
FROM (SELECT page_id, octet_length(encode(html)) AS b FROM pages)""")
def format_size(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", N.format_size(F.octet_length("html").cast("long")).alias("size"))


@query("""
SELECT event_id, CASE WHEN age < 30 THEN 1.0 WHEN age < 180 THEN 0.9 WHEN age < 365 THEN 0.8 WHEN age < 730 THEN 0.6 WHEN age < 1825 THEN 0.4 ELSE 0.2 END::DOUBLE AS recency
FROM (SELECT event_id, date_diff('day', ts::DATE, DATE '2024-12-01') AS age FROM events)""")
def recency_score(spark, sf_dir):
    age = F.datediff(F.lit("2024-12-01").cast("date"), F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", N.recency(age).alias("recency"))


_DOMAIN = "split_part(replace(regexp_replace(url, '^https?://', ''), 'www.', ''), '/', 1)"


@query(f"SELECT page_id, {_DOMAIN} AS domain FROM pages")
def url_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", N.domain(F.col("url")).alias("domain"))


HOSTS = ["www.tcmb.gov.tr", "tuik.gov.tr", "a.gov.tr", "metu.edu.tr", "notgov.tr", "data.worldbank.org", "ec.europa.eu", "example.com", "scholar.google.com", "un.org", "fun.org"]
_TRUST = " ".join(f"WHEN host = '{s}' OR ends_with(host, '.{s}') THEN {v}" for s, v in sorted(K.CREDIBILITY.items(), key=lambda x: (-len(x[0]), x[0])))


@query(f"""
WITH h AS (SELECT host, CASE {_TRUST} ELSE 0.5 END::DOUBLE AS trust FROM (VALUES {value_rows([(h,) for h in HOSTS])}) t(host))
SELECT host, trust, round_even((0.4::DOUBLE * 0.75 + 0.4::DOUBLE * trust + 0.2::DOUBLE * 0.9)::DOUBLE, 3) AS confidence FROM h""")
def url_credibility(spark, sf_dir):
    x = spark.createDataFrame([(h,) for h in HOSTS], "host string").withColumn("trust", N.credibility(F.col("host")))
    return x.withColumn("confidence", N.confidence(F.lit(0.75), F.col("trust"), F.lit(0.9)))


@query("SELECT p_partkey, round_even(((1 + p_size / 100.0::DOUBLE) / (1 + 0.25::DOUBLE) - 1) * 100, 2) AS real_rate, least(greatest(p_retailprice / 1000, 0), 1) AS score, CASE WHEN p_retailprice / 1000 >= 0.9 THEN 'excellent' WHEN p_retailprice / 1000 >= 0.7 THEN 'high' WHEN p_retailprice / 1000 >= 0.5 THEN 'medium' ELSE 'low' END AS level FROM part")
def rates_and_levels(spark, sf_dir):
    s = F.col("p_retailprice") / 1000
    return table(spark, sf_dir, "part").select("p_partkey", N.real_rate(F.col("p_size"), F.lit(25.0)).alias("real_rate"), F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)).alias("score"), N.quality_level(s).alias("level"))


@query("""
SELECT doc_id, list_filter(['null', 'empty', 'long'], lambda e: (e = 'null' AND text IS NULL) OR (e = 'empty' AND trim(text) = '') OR (e = 'long' AND length(text) > 10000)) AS errors,
  text IS NOT NULL AND trim(text) <> '' AND length(text) <= 10000 AS is_valid FROM documents""")
def row_validation(spark, sf_dir):
    c = F.col("text")
    errors = F.array_compact(F.array(F.when(c.isNull(), "null"), F.when(F.trim(c) == "", "empty"), F.when(F.length(c) > 10000, "long")))
    return _docs(spark, sf_dir).select("doc_id", errors.alias("errors"), (F.size(errors) == 0).alias("is_valid"))


@query(r"SELECT page_id, length(url) <= 2048 AND regexp_matches(url, '^https?://[^\s/$.?#].[^\s]*$') AS is_valid, starts_with(url, 'https://') AS is_https FROM pages")
def url_validation(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", ((F.length(u) <= 2048) & u.rlike(r"^https?://[^\s/$.?#].[^\s]*$")).alias("is_valid"), u.startswith("https://").alias("is_https"))


FILES = ["a.PDF", "b.xlsx", "c.csv", "d.docx", "e.JPEG", "f.tar.gz", "noext", "g.webp", 'bad<>:"name?.doc']
_EXT = " ".join(f"WHEN ext IN ({quoted(v)}) THEN '{k}'" for k, v in K.FILE_CATEGORIES.items())


@query(f"""
SELECT name, CASE {_EXT} ELSE 'unknown' END AS category, regexp_replace(name, '[<>:"/\\\\|?*]', '_', 'g') AS safe_name
FROM (SELECT name, lower(regexp_extract(name, '\\.[^.]*$')) AS ext FROM (VALUES {value_rows([(f,) for f in FILES])}) t(name))""")
def file_category(spark, sf_dir):
    from veldspar.sources.files import category_of

    x = spark.createDataFrame([(f,) for f in FILES], "name string")
    return x.select("name", category_of(F.col("name")).alias("category"), F.regexp_replace("name", r'[<>:"/\\|?*]', "_").alias("safe_name"))

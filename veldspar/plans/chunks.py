"""Queries of chunking, windows, tables in texts and query rewriting."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veldspar.functions import constants as K
from veldspar.functions import text as X
from veldspar.operators import chunking as H
from veldspar.operators import context as C
from veldspar.operators import rewriting as W
from veldspar.plans.registry import query, quoted, table, value_rows
from veldspar.plans.scalar import _TOKENS
from veldspar.sources.files import markdown_tables as find_tables


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query("""SELECT doc_id AS id, pos::INT AS pos, substr(text, (pos * 960 + 1)::INT, 1200) AS chunk
FROM (SELECT doc_id, text, unnest(range(greatest(0, ceil((length(text) - 1200) / 960.0))::BIGINT + 1)) AS pos FROM documents WHERE length(text) > 0) WHERE trim(substr(text, (pos * 960 + 1)::INT, 1200)) <> ''""")
def fixed_windows(spark, sf_dir):
    return H.windows(_docs(spark, sf_dir), 1200, 960)


@query(f"""WITH t AS (SELECT doc_id, text, ({_TOKENS}) <= 4000 AS whole FROM documents WHERE length(text) > 0),
p AS (SELECT doc_id, text, whole, unnest(range(CASE WHEN whole THEN 1 ELSE greatest(0, ceil((length(text) - 16000) / 14000.0))::BIGINT + 1 END)) AS pos FROM t)
SELECT doc_id AS id, pos::INT AS pos, length(CASE WHEN whole THEN text ELSE substr(text, (pos * 14000 + 1)::INT, 16000) END) AS chars FROM p""")
def sliding_windows(spark, sf_dir):
    whole = X.token_estimate(F.col("text")) <= 4000
    return H.windows(_docs(spark, sf_dir), 16000, 14000, whole=whole).select("id", "pos", F.length("chunk").cast("long").alias("chars"))


@query()
def semantic_chunks(spark, sf_dir):
    return H.enrich(H.chunks(_docs(spark, sf_dir), "semantic"))


@query()
def recursive_chunks(spark, sf_dir):
    return H.chunks(_docs(spark, sf_dir), "recursive")


@query()
def document_chunks(spark, sf_dir):
    return H.chunks(_docs(spark, sf_dir), "document")


@query()
def parent_child_chunks(spark, sf_dir):
    return H.parent_child(_docs(spark, sf_dir))


@query(r"""WITH l AS (SELECT doc_id, generate_subscripts(s, 1) AS n, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
g AS (SELECT *, sum(CASE WHEN regexp_full_match(line, '#{1,4}\s+.+') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS block FROM l),
b AS (SELECT doc_id, block, trim(string_agg(line, chr(10) ORDER BY n), E' \n\r\t') AS chunk FROM g GROUP BY ALL)
SELECT doc_id AS id, (row_number() OVER (PARTITION BY doc_id ORDER BY block) - 1)::INT AS pos, sha256(chunk) AS digest FROM b WHERE chunk <> ''""")
def sections_lateral(spark, sf_dir):
    """Heading blocks by the table function, in SQL."""
    H.register_functions(spark)
    _docs(spark, sf_dir).createOrReplaceTempView("veldspar_documents")
    return spark.sql("SELECT doc_id AS id, pos, sha2(CAST(chunk AS BINARY), 256) AS digest FROM veldspar_documents, LATERAL markdown_sections(text)")


@query("""SELECT doc_id AS id, true AS in_order, true AS whole FROM documents WHERE regexp_matches(text, '\\S')""")
def chunks_lateral(spark, sf_dir):
    """Chunks by the table function, in SQL, with what must hold of them: positions are 0, 1, 2, ..., and the first chunk begins and the last one
    ends as the text does."""
    H.register_functions(spark)
    _docs(spark, sf_dir).createOrReplaceTempView("veldspar_documents")
    made = spark.sql("SELECT doc_id AS id, text, pos, chunk FROM veldspar_documents, LATERAL text_chunks(text, 'semantic', 1200, 240)")
    plain = lambda c: F.regexp_replace(c, r"\s+", "")
    x = made.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("last"), F.min_by("chunk", "pos").alias("a"), F.max_by("chunk", "pos").alias("z"), F.first("text").alias("text"))
    whole = F.startswith(plain("text"), plain("a")) & F.endswith(plain("text"), plain("z"))
    return x.select("id", (F.col("n") == F.col("last") + 1).alias("in_order"), whole.alias("whole"))


_WINDOWS = "(SELECT doc_id, text, unnest(range(greatest(0, ceil((length(text) - {size}) / {size}.0))::BIGINT + 1)) AS pos FROM documents WHERE length(text) > 0)"


@query(f"""WITH c AS (SELECT doc_id AS id, pos // 4 AS parent_pos, pos, substr(text, (pos * 500 + 1)::INT, 500) AS chunk FROM {_WINDOWS.format(size=500)}), p AS (SELECT doc_id AS id, pos AS parent_pos, substr(text, (pos * 2000 + 1)::INT, 2000) AS parent FROM {_WINDOWS.format(size=2000)})
SELECT c.id, c.parent_pos::INT AS parent_pos, c.pos::INT AS pos, chunk, parent FROM c LEFT JOIN p ON p.id = c.id AND p.parent_pos = c.parent_pos AND trim(parent) <> '' WHERE trim(chunk) <> ''""")
def parent_context(spark, sf_dir):
    """Each child chunk with its parent's text, by a left join on the parent's key."""
    children = H.windows(_docs(spark, sf_dir), 500, 500).withColumn("parent_pos", F.floor(F.col("pos") / 4).cast("int"))
    parents = H.windows(_docs(spark, sf_dir), 2000, 2000).select("id", F.col("pos").alias("parent_pos"), F.col("chunk").alias("parent"))
    return H.parent_context(children, parents)


@query(r"""WITH l AS (SELECT doc_id, generate_subscripts(s, 1) AS n, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
g AS (SELECT *, sum(CASE WHEN regexp_full_match(line, '#{1,4}\s+.+') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS block FROM l),
b AS (SELECT doc_id, block, string_agg(line, chr(10) ORDER BY n) AS body FROM g GROUP BY ALL)
SELECT doc_id AS id, count(*) AS n_sections, max(length(trim(body, E' \n\r\t'))) AS longest FROM b WHERE trim(body, E' \n\r\t') <> '' GROUP BY doc_id""")
def markdown_sections(spark, sf_dir):
    return H.sections(_docs(spark, sf_dir)).groupBy("id").agg(F.count(F.lit(1)).alias("n_sections"), F.max(F.length("chunk")).cast("long").alias("longest"))


@query("""WITH RECURSIVE w AS (SELECT doc_id AS id, substr(text, (pos * 200 + 1)::INT, 300) AS chunk, pos FROM (SELECT doc_id, text, unnest(range(greatest(0, ceil((length(text) - 300) / 200.0))::BIGINT + 1)) AS pos FROM documents WHERE length(text) > 0)),
c AS (SELECT id, chunk, row_number() OVER (PARTITION BY id ORDER BY pos) AS n FROM w WHERE trim(chunk) <> ''),
f AS (SELECT id, n, 0::BIGINT AS pos, chunk AS cur FROM c WHERE n = 1 UNION ALL
  SELECT c.id, c.n, CASE WHEN contains(substr(chunk, 1, 200), right(cur, 100)) THEN pos ELSE pos + 1 END, CASE WHEN contains(substr(chunk, 1, 200), right(cur, 100)) THEN cur || substr(chunk, 101) ELSE chunk END FROM f JOIN c ON c.id = f.id AND c.n = f.n + 1)
SELECT id, pos, max_by(cur, n) AS text FROM f GROUP BY id, pos""")
def merge_overlapping(spark, sf_dir):
    """Overlapping windows folded back together."""
    made = H.windows(_docs(spark, sf_dir), 300, 200)
    return C.merge_overlaps(made.select("id", "pos", F.col("chunk").alias("text")), "id", "pos")


# Texts with Markdown tables.
TABLES = [
    (1, "Intro\n\n| Yıl | Pay |\n|---|---|\n| 2023 | %40 |\n| 2024 | %60 |\n\nEnd"),
    (2, "| A | B | C |\n| :-- | --: | - |\n| x | 1 | |\n| y | 2 | 3 |\n| z | 4 | 5 |\n"),
    (3, "no table | here"),
    (4, "Dağılım: Kara: 40% ve Deniz: 35% ve Hava: 25%"),
]


@query("SELECT * FROM (VALUES (1, 0, ['Yıl', 'Pay'], 2, '2023;%40|2024;%60'), (2, 0, ['A', 'B', 'C'], 3, 'x;1|y;2;3|z;4;5')) t(doc_id, \"table\", headers, n_rows, cells)")
def markdown_tables(spark, sf_dir):
    x = find_tables(spark.createDataFrame(TABLES, "doc_id int, text string"))
    return x.select("doc_id", "table", "headers", F.size("rows").alias("n_rows"), F.array_join(F.transform("rows", lambda r: F.array_join(r, ";")), "|").alias("cells"))


@query("SELECT * FROM (VALUES (1, 'pie', ['2023', '2024'], [40.0::DOUBLE, 60.0::DOUBLE]), (2, 'pie', ['x', 'y', 'z'], [1.0::DOUBLE, 2.0::DOUBLE, 4.0::DOUBLE]), (4, 'pie', ['Kara', 've Deniz', 've Hava'], [40.0::DOUBLE, 35.0::DOUBLE, 25.0::DOUBLE])) t(doc_id, kind, labels, \"values\")")
def chart_data(spark, sf_dir):
    return W.chart_data(spark.createDataFrame(TABLES, "doc_id int, text string"))


@query("SELECT doc_id, (floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 16))::BIGINT AS batch, source FROM documents")
def batches(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.floor((n - 1) / 16).alias("batch"))


@query("SELECT item_id, a.text = b.text AS same, round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))), 6) AS jaccard FROM (SELECT item_id, text, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')[:100]) AS x FROM benchmark) a JOIN (SELECT item_id - 1 AS item_id, text, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')[:100]) AS y FROM benchmark) b USING (item_id)")
def jaccard_similarity(spark, sf_dir):
    words = F.slice(X.lower_words(F.col("text")), 1, 100)
    b = table(spark, sf_dir, "benchmark").select("item_id", "text", words.alias("w"))
    n = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("t"), F.col("w").alias("v"))
    return b.join(n, "item_id").select("item_id", (F.col("text") == F.col("t")).alias("same"), F.round(X.jaccard(F.col("w"), F.col("v")), 6).alias("jaccard"))


# Query rewriting

ASKS = [(1, "pazar analizi ve gelir tahmini"), (2, "gelir"), (3, "sirket hedef, musteri yorumu, fiyat"), (4, "bu cok uzun bir sorgu cumlesi olup on kelimeden fazla kelime icermektedir simdi"), (5, "risk ile firsat")]
_ASKS = f"(VALUES {value_rows(ASKS)}) a(query_id, text)"


@query(f"""SELECT query_id, CASE WHEN n > 10 THEN 'decomposition' WHEN n < 4 THEN 'expansion' ELSE 'expansion' END AS strategy FROM (SELECT query_id, len(string_split(text, ' ')) AS n FROM {_ASKS})""")
def query_strategy(spark, sf_dir):
    return spark.createDataFrame(ASKS, "query_id int, text string").select("query_id", W.strategy(F.col("text")).alias("strategy"))


_PARTS = "CASE " + " ".join(f"WHEN contains(lower(text), ' {c} ') THEN string_split(lower(text), ' {c} ')" for c in K.CONJUNCTIONS) + " WHEN contains(text, ',') THEN string_split(text, ',') ELSE [text] END"


@query(f"""SELECT query_id, trim(p) AS part FROM (SELECT query_id, text, unnest({_PARTS}) AS p, len({_PARTS}) AS n FROM {_ASKS}) WHERE n = 1 OR length(trim(p)) > 5""")
def query_decompose(spark, sf_dir):
    return spark.createDataFrame(ASKS, "query_id int, text string").select("query_id", F.explode(W.decompose(F.col("text"))).alias("part"))


_SYN = value_rows([(i * 10 + j, head, word) for i, (head, ws) in enumerate(K.SYNONYMS.items()) for j, word in enumerate(ws[:2])])


@query(f"""WITH e AS (SELECT query_id, 0 AS ord, text AS variant FROM {_ASKS} UNION ALL SELECT query_id, ord + 1, replace(lower(text), head, word) FROM {_ASKS}, (VALUES {_SYN}) s(ord, head, word) WHERE contains(lower(text), head)),
d AS (SELECT query_id, variant, min(ord) AS ord FROM e GROUP BY ALL) SELECT query_id, variant, n FROM (SELECT query_id, variant, row_number() OVER (PARTITION BY query_id ORDER BY ord)::INT AS n FROM d) WHERE n <= 5""")
def query_expand(spark, sf_dir):
    return W.expand(spark.createDataFrame(ASKS, "query_id int, text string"))


@query(f"SELECT section, replace(template, '{{title}}', 'Rapor') AS text FROM (VALUES {value_rows([(s, t) for s, ts in K.SECTION_TEMPLATES.items() for t in ts])}) t(section, template)")
def section_queries(spark, sf_dir):
    return W.section_queries(spark, "Rapor")


@query(f"SELECT section, replace(template, '{{title}}', 'Rapor') AS text FROM (VALUES {value_rows(K.SECTION_QUERIES.items())}) t(section, template)")
def section_query(spark, sf_dir):
    return W.section_query(spark, "Rapor")


SUBJECTS = [(1, "Online satış ve dijital bankacılık"), (2, "Yeni otel yatırımı"), (3, "Güneş enerjisi"), (4, "Bilinmeyen konu")]
_SECTOR = " ".join(f"WHEN {' OR '.join(f'contains(low, {quoted([k])})' for k in ks)} THEN '{s}'" for s, ks in K.SECTORS.items())


@query(f"SELECT id, CASE {_SECTOR} END AS sector FROM (SELECT id, lower(text) AS low FROM (VALUES {value_rows(SUBJECTS)}) t(id, text))")
def sector_detect(spark, sf_dir):
    return spark.createDataFrame(SUBJECTS, "id int, text string").select("id", W.sector(F.col("text")).alias("sector"))


@query(f"""SELECT section, least_words, most_words, paragraphs, greatest(300, least_words) AS target_least, string_agg(template, '; ' ORDER BY ord) AS queries
FROM (VALUES {value_rows([(s, *t) for s, t in K.SECTION_TARGETS.items()])}) t(section, least_words, most_words, paragraphs) LEFT JOIN (VALUES {value_rows([(s, i, t) for s, ts in K.SECTION_TEMPLATES.items() for i, t in enumerate(ts)])}) q(section, ord, template) USING (section) GROUP BY ALL""")
def content_plan(spark, sf_dir):
    return W.content_plan(spark)

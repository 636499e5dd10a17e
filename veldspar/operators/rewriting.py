"""Query rewriting, section plans and chart data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veldspar.functions import constants as K
from veldspar.functions import text as X
from veldspar.operators.providers import Provider, generate
from veldspar.sources.files import markdown_tables


def strategy(text: Column, generator: bool = False) -> Column:
    """decomposition for more than ten words, expansion for less than four, else multi_query if a text
    generator is at hand."""
    n = F.size(X.words(text))
    return F.when(n > 10, "decomposition").when(n < 4, "expansion").otherwise("multi_query" if generator else "expansion")


def decompose(text: Column) -> Column:
    """Parts between the first conjunction present, else between commas, if longer than five characters."""
    low = F.lower(text)
    parts = F.when(text.contains(","), F.split(text, ",")).otherwise(F.array(text))
    for c in reversed(K.CONJUNCTIONS):
        parts = F.when(low.contains(f" {c} "), F.split(low, f" {c} ")).otherwise(parts)
    trimmed = F.transform(parts, lambda x: F.trim(x))
    return F.when(F.size(parts) == 1, trimmed).otherwise(F.filter(trimmed, lambda p: F.length(p) > 5))


def expand(queries: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, variant, n): the query and variants with a synonym put in, without repeats."""
    low = F.lower("text")
    made = [F.when(low.contains(head), F.replace(low, F.lit(head), F.lit(w))) for head, words in K.SYNONYMS.items() for w in words[:2]]
    variants = F.slice(F.array_distinct(F.array_compact(F.array(F.col("text"), *made))), 1, most)
    return queries.select("query_id", F.posexplode(variants).alias("n", "variant")).select("query_id", "variant", (F.col("n") + 1).alias("n"))


def section_queries(spark: SparkSession, title: str) -> DataFrame:
    rows = [(s, t) for s, ts in K.SECTION_TEMPLATES.items() for t in ts]
    return spark.createDataFrame(rows, "section string, template string").select("section", F.replace("template", F.lit("{title}"), F.lit(title)).alias("text"))


def section_query(spark: SparkSession, title: str) -> DataFrame:
    return spark.createDataFrame(list(K.SECTION_QUERIES.items()), "section string, template string").select("section", F.replace("template", F.lit("{title}"), F.lit(title)).alias("text"))


def sector(text: Column) -> Column:
    """The first listed sector one of whose words the text has."""
    low, out = F.lower(text), F.lit(None).cast("string")
    for name, words in reversed(K.SECTORS.items()):
        out = F.when(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), name).otherwise(out)
    return out


def content_plan(spark: SparkSession, floor: int = 300) -> DataFrame:
    """Sections with word targets and search phrases."""
    targets = spark.createDataFrame([(s, *t) for s, t in K.SECTION_TARGETS.items()], "section string, least_words int, most_words int, paragraphs int")
    phrases = spark.createDataFrame([(s, i, t) for s, ts in K.SECTION_TEMPLATES.items() for i, t in enumerate(ts)], "section string, ord int, template string")
    ordered = F.array_sort(F.collect_list(F.struct("ord", "template")))
    phrases = phrases.groupBy("section").agg(F.array_join(F.transform(ordered, lambda r: r["template"]), "; ").alias("queries"))
    return targets.join(phrases, "section", "left").withColumn("target_least", F.greatest(F.lit(floor), "least_words"))


def chart_data(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, labels, values) of tables with two rows or more, and of three or more `label: n%`."""

    def number(cell: Column) -> Column:
        digits = F.regexp_replace(F.replace(cell, F.lit(","), F.lit(".")), "[^0-9.]", "")
        return F.coalesce(digits.try_cast("double"), F.lit(0.0))

    sum_of = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    t = markdown_tables(docs).where((F.size("headers") >= 2) & (F.size("rows") >= 2)).withColumn("rows", F.filter("rows", lambda r: F.size(r) >= 2))
    t = t.select("doc_id", F.transform("rows", lambda r: r[0]).alias("labels"), F.transform("rows", lambda r: number(r[1])).alias("values"), F.exists("rows", lambda r: F.array_join(r, "").contains("%")).alias("percent"))
    t = t.where(sum_of(F.col("values")) > 0).select("doc_id", F.when(F.col("percent") | (sum_of(F.col("values")) <= 100), "pie").otherwise("bar").alias("kind"), "labels", "values")
    pattern = r"([\p{L}\p{N}_][\p{L}\p{N}_\s]+):\s*%?\s*([0-9.,]+)\s*%"
    labels, shares = F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), F.regexp_extract_all("text", F.lit(pattern), F.lit(2))
    p = docs.where(F.size(labels) >= 3).select("doc_id", F.lit("pie").alias("kind"), F.transform(labels, lambda x: F.trim(x)).alias("labels"), F.transform(shares, number).alias("values"))
    return t.unionByName(p)


def top_charts(charts: DataFrame, per_section: int = 2, most: int = 10) -> DataFrame:
    """At most two charts a section and ten in all."""
    w = Window.partitionBy("doc_id").orderBy("labels")
    return charts.withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_section).orderBy("doc_id", "n").limit(most).drop("n")


def hypothetical(queries: DataFrame, provider: Provider, most_words: int = 150, context: Column | None = None) -> DataFrame:
    """(query_id, text, variant): an ideal answer to each query, to search with in its place; the query itself where the
    provider has none."""
    told = F.concat(F.lit(f"Write a paragraph of at most {most_words} words that answers the question.\nQuestion: "), "text", *([] if context is None else [F.lit("\nContext: "), context]))
    answer = F.trim(F.coalesce(F.col("answer"), F.lit("")))
    return generate(queries, told, provider).select("query_id", "text", F.when(answer == "", F.col("text")).otherwise(answer).alias("variant"))


def multiple(queries: DataFrame, provider: Provider, count: int = 3) -> DataFrame:
    """(query_id, variant, n): the query and up to count - 1 rewordings, a line of the provider's answer each."""
    told = F.concat(F.lit(f"Reword the query in {count} ways, one a line.\nQuery: "), "text")
    lines = F.filter(F.transform(F.split(F.coalesce(F.col("answer"), F.lit("")), "\n"), lambda s: F.trim(s)), lambda s: s != "")
    made = F.concat(F.array("text"), F.slice(lines, 1, count - 1))
    return generate(queries, told, provider).select("query_id", F.posexplode(made).alias("n", "variant")).select("query_id", "variant", (F.col("n") + 1).alias("n"))


def optimise(queries: DataFrame, provider: Provider | None = None, chosen: str = "auto") -> DataFrame:
    """(query_id, strategy, variant, n): each query by its strategy. Those that want a provider, and any unknown one, leave
    the query as it is where there is none."""
    asked = queries.select("query_id", "text", (strategy(F.col("text"), provider is not None) if chosen == "auto" else F.lit(chosen)).alias("strategy"))
    of = lambda name: asked.where(F.col("strategy") == name)
    parts = of("decomposition").select("query_id", F.posexplode(decompose(F.col("text"))).alias("n", "variant")).select("query_id", "variant", (F.col("n") + 1).alias("n"))
    made = [("decomposition", parts), ("expansion", expand(of("expansion")))]
    if provider is not None:
        made += [("hyde", hypothetical(of("hyde"), provider).select("query_id", "variant", F.lit(1).alias("n"))), ("multi_query", multiple(of("multi_query"), provider))]
    made.append(("none", asked.where(~F.col("strategy").isin([n for n, _ in made])).select("query_id", F.col("text").alias("variant"), F.lit(1).alias("n"))))
    return reduce(DataFrame.unionByName, [x.select("query_id", F.lit(n).alias("strategy"), "variant", "n") for n, x in made])


def title(kind: Column, notes: Column, year: int) -> Column:
    """The title of a report: the first five words of its notes, if it has any, its type and the year."""
    name = F.lit("Rapor")
    for k, v in K.REPORT_NAMES.items():
        name = F.when(kind == k, v).otherwise(name)
    topic = F.array_join(F.slice(X.words(F.coalesce(notes, F.lit(""))), 1, 5), " ")
    return F.concat(F.when(topic == "", "").otherwise(F.concat(topic, F.lit(" - "))), name, F.lit(f" {year}"))


def research_topics(kind: Column, notes: Column, text: Column) -> Column:
    """Up to five topics: two of the report's type, the notes, and what the files are about."""
    base = F.array(F.lit("iş analizi"))
    for k, v in K.REPORT_TOPICS.items():
        base = F.when(kind == k, F.array(*map(F.lit, v[:2]))).otherwise(base)
    note = F.trim(F.substring(F.coalesce(notes, F.lit("")), 1, 100))
    more = F.array_compact(F.array(F.when(note != "", note), F.when(F.length(text) > 0, F.concat(F.substring(text, 1, 100), F.lit(" sektör analizi")))))
    return F.slice(F.concat(base, more), 1, 5)


def plan_warnings(plan: DataFrame, least_total: int = 2000, least: int = 300, sourced: tuple[str, ...] = ("pazar_analizi", "finansal_projeksiyonlar")) -> DataFrame:
    """(section, warning) of plan(section, target_words, required, n_points, n_sources); section is null for the whole."""
    total = plan.agg(F.sum("target_words").alias("n")).where(F.coalesce("n", F.lit(0)) < least_total).select(F.lit(None).cast("string").alias("section"), F.lit("few_words_in_all").alias("warning"))
    found = F.array_compact(F.array(
        F.when(F.col("required") & (F.col("target_words") < least), "few_words"), F.when(F.col("n_points") == 0, "no_key_points"),
        F.when(F.col("section").isin(*sourced) & (F.col("n_sources") == 0), "no_sources"),
    ))
    return total.unionByName(plan.select("section", F.explode(found).alias("warning")))

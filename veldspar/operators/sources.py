"""Sources and citations: duplicates, topics, corroboration, numbering and renderings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veldspar.functions import constants as K
from veldspar.functions import text as X
from veldspar.functions.text import CASELESS
from veldspar.operators.context import meetings
from veldspar.operators.relational import ordinal
from veldspar.operators.scratch import materialise


def merge_by_url(found: DataFrame) -> DataFrame:
    """found(url, title, snippet, query, pos): one row a URL with its first title and snippet and all queries."""
    first = F.min_by(F.struct("title", "snippet"), "pos")
    return found.groupBy("url").agg(first.alias("first"), F.array_join(F.array_sort(F.collect_set("query")), ", ").alias("queries"), F.min("pos").alias("pos")).select("url", "first.title", "first.snippet", "queries", "pos")


def topics_of(text: Column) -> Column:
    """Sections one of whose topics the text mentions."""
    low = F.lower(text)
    any_of = lambda words: low.rlike("|".join(re.escape(w) for w in words))
    return F.array_compact(F.array(*[F.when(any_of(words), F.lit(s)) for s, words in K.SECTION_TOPICS.items()]))


def assign_sections(sources: DataFrame, most: int | None = None) -> DataFrame:
    """(url, section), up to `most` sources a section in order of pos."""
    x = sources.select("url", "pos", F.explode(topics_of(F.concat_ws(" ", "title", "snippet"))).alias("section"))
    if most is None:
        return x.select("url", "section")
    return x.withColumn("n", F.row_number().over(Window.partitionBy("section").orderBy("pos"))).where(F.col("n") <= most).select("url", "section")


def for_sections(sources: DataFrame, sections: list[str], least: int = 3, min_credibility: float = 0.5) -> DataFrame:
    """(section, url, direct, rank): direct hits first, filled up to `least` by credibility, at most twice `least`."""
    wanted = F.explode(F.array(*[F.lit(s) for s in sections])).alias("section")
    x = sources.where(F.col("credibility") >= min_credibility).select("*", wanted)
    x = x.withColumn("direct", F.array_contains(topics_of(F.concat_ws(" ", "title", "snippet")), F.col("section")))
    w = Window.partitionBy("section").orderBy(F.desc("direct"), F.desc("credibility"), "pos")
    x = x.withColumn("rank", F.row_number().over(w)).withColumn("n_direct", F.sum(F.col("direct").cast("int")).over(Window.partitionBy("section")))
    return x.where(F.col("rank") <= F.least(F.lit(2 * least), F.greatest(F.lit(least), "n_direct"))).select("section", "url", "direct", "rank")


def corroborated(sources: DataFrame, id_col: str, text_col: str, shared: int = 3, partners: int = 2, word: str = r"[\p{L}]{4,}") -> DataFrame:
    """(id, n_partners, verified): sources that share at least `shared` words of four letters with others.

    Sources with one set of words are one group, which is compared once. Words are ordered from rare to frequent:
    groups that share so many words share one among all but the last shared - 1 of each, so the most frequent
    words of a group never reach the join, and words of many groups are split."""
    x = sources.select(F.col(id_col).alias("id"), F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text_col), F.lit(word), F.lit(0)))).alias("w"))
    x = materialise(x.withColumn("g", F.xxhash64("w")), "source-words")
    groups = materialise(x.groupBy("g", "w").agg(F.count(F.lit(1)).alias("n")), "source-groups")
    words = groups.where(F.size("w") >= shared).select("g", F.size("w").alias("size"), F.explode("w").alias("word"))
    rare = words.groupBy("word").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = words.join(rare, "word", "left").withColumn("at", F.row_number().over(Window.partitionBy("g").orderBy(F.col("df").asc_nulls_first(), "word")))
    prefix = materialise(ranked.where((F.col("at") <= F.col("size") - shared + 1) & F.col("df").isNotNull()).select("word", "g"), "source-prefixes")
    pairs = meetings(prefix, "word", ["g"]).where("a_g < b_g").select(F.col("a_g").alias("a"), F.col("b_g").alias("b")).distinct()
    sets = lambda side: groups.select(F.col("g").alias(side), F.col("w").alias(f"w_{side}"))
    met = pairs.join(sets("a"), "a").join(sets("b"), "b").where(F.size(F.array_intersect("w_a", "w_b")) >= shared).select("a", "b")
    met = materialise(met, "source-pairs")
    both = met.unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(groups.select(F.col("g").alias("b"), "n"), "b").groupBy(F.col("a").alias("g")).agg(F.sum("n").alias("other"))
    own = F.when(F.size("w") >= shared, F.col("n") - 1).otherwise(0)
    known = groups.join(others, "g", "left").select("g", (own + F.coalesce("other", F.lit(0))).alias("n_partners"))
    return x.join(known, "g").select("id", "n_partners", (F.col("n_partners") >= partners).alias("verified"))


def number_citations(citations: DataFrame) -> DataFrame:
    """citations(pos, url, section) with n: 1, 2, ... by first appearance of the URL."""
    first = ordinal(citations.groupBy("url").agg(F.min("pos").alias("first")), ["first", "url"])
    return citations.join(first.select("url", "n"), "url")


def statistics(citations: DataFrame) -> DataFrame:
    """(section, citations, sources)."""
    return citations.groupBy("section").agg(F.count(F.lit(1)).alias("citations"), F.countDistinct("url").alias("sources"))


def most_cited(citations: DataFrame) -> DataFrame:
    """The URL cited most, ties to the first cited."""
    counts = citations.groupBy("url").agg(F.count(F.lit(1)).alias("times"), F.min("pos").alias("first"))
    return counts.orderBy(F.desc("times"), "first").limit(1).select("url", "times")


def bibliography(sources: DataFrame) -> DataFrame:
    """(n, line) in order of the lowered title."""
    return ordinal(sources.select("title", "url"), [F.lower("title"), F.col("url")]).select("n", F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), "title", F.lit(". "), "url").alias("line"))


def insert_citations(texts: DataFrame, best: Column) -> DataFrame:
    """texts(id, text) with a marker of the best source after every claim, pattern by pattern; unchanged where there
    is no source."""
    marked = F.col("text")
    for pattern in K.CITATION_PATTERNS:
        marked = F.regexp_replace(marked, F.lit(CASELESS + pattern), F.concat(F.lit("$0 ["), best.cast("string"), F.lit("]")))
    return texts.select("id", F.when(best.isNull(), F.col("text")).otherwise(marked).alias("text"))


def claims(text: Column) -> Column:
    """All wordings of a text that want a citation, pattern by pattern."""
    return F.concat(*[F.regexp_extract_all(text, F.lit(CASELESS + p), F.lit(0)) for p in K.CITATION_PATTERNS])


def best_source(scored: DataFrame, group: str, least: float = 0.4) -> DataFrame:
    """The source of largest confidence, if it is at least `least`."""
    x = scored.where(F.col("confidence") >= least).groupBy(group).agg(F.max(F.struct("confidence", (-F.col("source_id")).alias("m"))).alias("b"))
    return x.select(group, (-F.col("b.m")).alias("source_id"), "b.confidence")


def validity(excerpt: Column, content: Column, credibility: Column, recency: Column) -> Column:
    """1 less .2 for low credibility, .1 for age, .3 for an excerpt most of whose first 20 words are missing."""
    words = F.slice(X.lower_words(excerpt), 1, 20)
    share = X.keyword_overlap(words, X.lower_words(content))
    return F.lit(1.0) - F.when(credibility < 0.5, 0.2).otherwise(0.0) - F.when(recency < 0.5, 0.1).otherwise(0.0) - F.when(share < 0.3, 0.3).otherwise(0.0)


def numbers_in_context(text: Column) -> Column:
    """Numbers with a unit and up to 30 characters before and after."""
    return F.regexp_extract_all(text, F.lit(r"(?is).{0,30}?[0-9]+[.,]?[0-9]*\s*(?:%|milyon|milyar|TL|USD|EUR).{0,30}"), F.lit(0))


def citations_json(citations: DataFrame) -> DataFrame:
    """One row: citations(pos, n, url, section, text) as JSON, in order."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "n", "url", "section", "text")))
    return citations.agg(F.to_json(ordered).alias("json"))


def citations_markdown(citations: DataFrame, most: int = 100) -> DataFrame:
    """(section, text): a heading for each section, and a line for each of its citations in order."""
    line = F.concat(F.lit("- ["), F.col("n").cast("string"), F.lit("] "), F.substring(F.coalesce("text", F.lit("")), 1, most), F.lit("... ("), "url", F.lit(")"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))), lambda r: r["l"])
    return citations.groupBy("section").agg(F.concat(F.lit("## "), F.col("section").cast("string"), F.lit("\n\n"), F.array_join(ordered, "\n")).alias("text"))

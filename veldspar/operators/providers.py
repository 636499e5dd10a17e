"""Text and vector providers, and parsers of their answers.

A provider is a function from a list of prompts to a list of answers, called once a batch on the executors.
The offline ones are deterministic; no verified result depends on another.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from typing import TypeVar

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.functions import numbers as N
from veldspar.functions import text as X

Provider = Callable[[list[str]], list[str]]
T = TypeVar("T")


def echo(prompts: list[str]) -> list[str]:
    """The offline text provider: the prompt itself."""
    return prompts


#: Waits between attempts: the first, the factor by which they grow, and the longest, in seconds.
FIRST_WAIT, GROWTH, LONGEST_WAIT = 2.0, 1.5, 10.0


def patiently(call: Callable[[], list], attempts: int, wait: Callable[[float], None] = time.sleep) -> tuple[list | None, str | None]:
    """What a call returns, or the error of its last attempt; after each one that fails it waits, longer every time."""
    pause = FIRST_WAIT
    for left in reversed(range(attempts)):
        try:
            return call(), None
        except Exception as e:
            if not left:
                return None, f"{type(e).__name__}: {e}"
            wait(pause)
            pause = min(pause * GROWTH, LONGEST_WAIT)
    return None, "no attempt"


def in_order(calls: Iterator[Callable[[], T]], workers: int) -> Iterator[T]:
    """The results of calls in their order, of which so many run at a time and no more than that are started ahead."""
    with ThreadPoolExecutor(workers) as pool:
        held: deque = deque()
        for call in calls:
            held.append(pool.submit(call))
            if len(held) >= workers:
                yield held.popleft().result()
        while held:
            yield held.popleft().result()


def generate(rows: DataFrame, prompt: Column, provider: Provider = echo, batch: int = 32, attempts: int = 3, workers: int = 4, errors: str | None = None, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """rows with the provider's answer to prompt, in batches of which `workers` are asked at a time in each task.

    A batch that fails is asked again after a wait of 2 seconds, then 3, up to 10. After the last attempt its rows get a null answer and
    the error in the column `errors`; without such a column the task fails. A provider that gives more or fewer answers than prompts is
    an error, too. Answers stay with their rows, whatever order they come in."""

    def asked(some: list[str]) -> tuple[list[str | None], list[str | None]]:
        def call() -> list[str]:
            answers = list(provider(some))
            if len(answers) != len(some):
                raise ValueError(f"{len(answers)} answers to {len(some)} prompts")
            return answers

        answers, error = patiently(call, attempts, wait)
        if error and errors is None:
            raise RuntimeError(error)
        return ([None] * len(some) if answers is None else answers), [error] * len(some)

    @F.pandas_udf("answer string, error string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for prompts in batches:
            texts = [p or "" for p in prompts]
            parts = in_order((partial(asked, texts[at : at + batch]) for at in range(0, len(texts), batch)), workers)
            answers, said = [], []
            for a, e in parts:
                answers += a
                said += e
            yield pd.DataFrame({"answer": pd.Series(answers, dtype=object), "error": pd.Series(said, dtype=object)})

    held = rows.withColumn("__asked", ask(prompt)).withColumn("answer", F.col("__asked.answer"))
    return (held if errors is None else held.withColumn(errors, F.col("__asked.error"))).drop("__asked")


def relevance_by(rows: DataFrame, ask: Column, text: Column, model: Callable[[list[tuple[str, str]]], list[float]], batch: int = 32, attempts: int = 3, workers: int = 4, name: str = "relevance") -> DataFrame:
    """rows with the relevance that a model of pairs (a cross-encoder) gives to (ask, text), in batches as `generate` asks them. A model that
    fails for good gives null, so a reranking falls back to the score that is there."""

    def asked(pairs: list[tuple[str, str]]) -> list[float | None]:
        scores, _ = patiently(lambda: [float(x) for x in model(pairs)], attempts)
        return scores if scores is not None and len(scores) == len(pairs) else [None] * len(pairs)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for x in batches:
            pairs = [(a or "", b or "") for a, b in zip(x["ask"], x["text"], strict=True)]
            parts = in_order((partial(asked, pairs[at : at + batch]) for at in range(0, len(pairs), batch)), workers)
            yield pd.Series([v for p in parts for v in p], dtype="float64")

    return rows.withColumn(name, score(F.struct(ask.alias("ask"), text.alias("text"))))


def embed(rows: DataFrame, text: Column, query: bool = False, instructed: bool = True, model: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """rows with an embedding: of a model, or the hash of the text. Instructed models want a prefix."""
    told = F.concat(F.lit("query: " if query else "passage: "), text) if instructed else text
    if model is None:
        return rows.withColumn("embedding", X.hash_embedding(told))

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model([t or "" for t in texts]))

    return rows.withColumn("embedding", vectors(told))


def indicator(answer: Column) -> Column:
    """(value, period, source) of an answer in lines DEĞER, DÖNEM, KAYNAK."""
    field = lambda k: F.trim(F.regexp_extract(answer, rf"(?m)^\s*{k}:\s*(.+)$", 1))
    return F.struct(N.parse_number(F.regexp_extract(field("DEĞER"), r"-?[0-9][0-9.,]*", 0)).alias("value"), F.nullif(field("DÖNEM"), F.lit("")).alias("period"), F.nullif(field("KAYNAK"), F.lit("")).alias("source"))


def key_values(answer: Column) -> Column:
    """A map of the lines KEY: value."""
    lines = F.filter(F.split(answer, "\n"), lambda s: s.rlike(r"^\s*[^:\s][^:]*:\s*\S"))
    pairs = F.transform(lines, lambda s: F.struct(F.trim(F.split_part(s, F.lit(":"), F.lit(1))).alias("k"), F.trim(F.regexp_replace(s, r"^[^:]*:", "")).alias("v")))
    first = F.filter(pairs, lambda p, i: F.size(F.filter(F.slice(pairs, 1, i), lambda q: q["k"] == p["k"])) == 0)
    return F.map_from_entries(first)


def _bullets(part: Column) -> Column:
    lines = F.filter(F.transform(F.split(part, "\n"), lambda s: F.trim(s)), lambda s: s.rlike(r"^([0-9]|[-•])"))
    return F.filter(F.transform(lines, lambda s: F.regexp_replace(F.regexp_replace(s, r"^[0-9]+\.\s*", ""), r"^[-•]\s*", "")), lambda s: s != "")


def research(answer: Column) -> Column:
    """(summary, facts, statistics) of an answer with the headings ÖZET, ANAHTAR BİLGİLER, İSTATİSTİKLER."""
    section = lambda k: F.regexp_extract(answer, rf"(?s)## {k}(.*?)(?=## |\z)", 1)
    return F.struct(F.regexp_replace(section("ÖZET"), r"^\s+|\s+\z", "").alias("summary"), _bullets(section("ANAHTAR BİLGİLER")).alias("facts"), _bullets(section("İSTATİSTİKLER")).alias("statistics"))


def critique(answer: Column) -> Column:
    """(score, issues, suggestions, summary) of a critique in lines SKOR, SORUNLAR, ÖNERİLER, ÖZET."""
    score = F.regexp_extract(answer, r"(?m)^\s*SKOR:[^0-9\n]*([0-9]+)", 1).try_cast("int")
    listed = lambda k: F.transform(F.regexp_extract_all(F.regexp_extract(answer, rf"(?ms)^\s*{k}:(.*?)(?=^\s*(?:SORUNLAR|ÖNERİLER|ÖZET|SKOR):|\z)", 1), F.lit(r"(?m)^\s*- (.+)$"), F.lit(1)), lambda s: F.trim(s))
    return F.struct(F.when(score.isNull(), 75).otherwise(F.least(F.lit(100), score)).alias("score"), listed("SORUNLAR").alias("issues"), listed("ÖNERİLER").alias("suggestions"), F.trim(F.regexp_extract(answer, r"(?m)^\s*ÖZET:(.*)$", 1)).alias("summary"))


def improved(score: Column, issues: Column, limit: int = 85) -> Column:
    """Whether a text should be written again."""
    return (score < limit) | (F.size(issues) > 0)


def improvement_summary(results: DataFrame) -> DataFrame:
    """One row of results(section, score, improved, issues): sections, those improved, the mean score, and a line for each
    section with its first two issues."""
    line = F.concat("section", F.lit(": "), F.col("score").cast("string"), F.lit("/100"), F.when(F.col("improved"), " +").otherwise(""), F.when(F.size("issues") > 0, F.concat(F.lit(" ("), F.array_join(F.slice("issues", 1, 2), ", "), F.lit(")"))).otherwise(""))
    return results.agg(F.count(F.lit(1)).alias("sections"), F.count_if("improved").alias("improved"), F.round(F.avg("score"), 6).alias("mean_score"), F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))


def write_sections(plan: DataFrame, context: DataFrame, provider: Provider, least_share: float = 0.8) -> DataFrame:
    """(section, content, words) of plan(section, title, target_words, queries) with the context(section, context) found for
    each; a text of fewer words than least_share of its target is written once more with what there is."""
    rows = plan.join(context, "section", "left").withColumn("context", F.coalesce("context", F.lit("")))
    told = F.concat(F.lit("Write the section "), "title", F.lit(" in "), F.col("target_words").cast("string"), F.lit(" words.\n"), F.coalesce("queries", F.lit("")), F.lit("\n"), "context")
    first = generate(rows, told, provider).withColumnRenamed("answer", "content")
    short = F.size(X.words(F.col("content"))) < least_share * F.col("target_words")
    longer = generate(first.where(short), F.concat(F.lit("Lengthen this to "), F.col("target_words").cast("string"), F.lit(" words:\n"), "content"), provider)
    done = first.where(~short).select("section", "content").unionByName(longer.select("section", F.col("answer").alias("content")))
    return done.withColumn("words", F.size(X.words(F.col("content"))))


#: From queries to results (title, url, snippet) of each, in order.
Search = Callable[[list[str]], list[list[tuple[str, str, str]]]]


def search(queries: DataFrame, provider: Search, most: int = 10) -> DataFrame:
    """(query, pos, title, url, snippet): the first results of a search provider for each of queries(query)."""

    @F.pandas_udf("array<struct<title string, url string, snippet string>>")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for asked in batches:
            yield pd.Series([[{"title": t, "url": u, "snippet": s} for t, u, s in found[:most]] for found in provider([q or "" for q in asked])])

    return queries.select("query", F.posexplode(ask("query")).alias("pos", "r")).select("query", "pos", "r.*")


def research_summary(found: DataFrame, most: int = 5) -> DataFrame:
    """(query, text): a line for each of a query's first results."""
    ordered = F.slice(F.array_sort(F.collect_list(F.struct("pos", "title", "url", "snippet"))), 1, most)
    lines = F.transform(ordered, lambda r: F.concat(F.lit("- "), r["title"], F.lit(" ("), r["url"], F.lit("): "), F.coalesce(r["snippet"], F.lit(""))))
    return found.groupBy("query").agg(F.array_join(lines, "\n").alias("text"))

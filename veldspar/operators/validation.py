"""Checks of report sections: numbers, metrics across sections, logic, rules, scores.

Input rows are sections(report_id, section_id, ord, title, level, content).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veldspar.functions import constants as K
from veldspar.functions import numbers as N
from veldspar.functions import text as X


def metric_value(text: Column, metric: str) -> Column:
    """The first parsable hit of a metric's patterns, times a million or billion if the hit says so."""
    hits = []
    for p in K.METRIC_PATTERNS[metric]:
        found = F.struct(F.regexp_extract(text, X.CASELESS + p, 0).alias("whole"), F.regexp_extract(text, X.CASELESS + p, 1).alias("digits"))
        # Held, as each mention of an expression on the whole text would run it anew.
        hits.append(X.let(found, _scaled))
    return F.coalesce(*hits)


def _scaled(hit: Column) -> Column:
    low = F.lower(hit["whole"])
    scale = F.when(low.contains("milyar"), 1e9).when(low.contains("milyon"), 1e6).otherwise(1.0)
    return F.when(hit["whole"] != "", N.simple_number(hit["digits"]) * scale)


def metrics(sections: DataFrame) -> DataFrame:
    """(report_id, metric, section_id, ord, value) of all sections."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), metric_value(F.col("content"), m).alias("value")) for m in K.METRIC_PATTERNS])
    return sections.select("report_id", "section_id", "ord", F.inline(pairs)).where("value is not null")


def cross_reference(sections: DataFrame, tolerance: float = 0.1, close: float = 0.2) -> DataFrame:
    """Metrics that differ from the value of the first section that has them: warnings up to `close`, errors
    beyond. A window holds the sections of one report."""
    first = F.first("value").over(Window.partitionBy("report_id", "metric").orderBy("ord"))
    x = metrics(sections).withColumn("expected", first)
    apart = F.when((F.col("value") == 0) & (F.col("expected") == 0), 0.0).when((F.col("value") == 0) | (F.col("expected") == 0), float("inf"))
    apart = apart.otherwise(F.abs(F.col("value") - F.col("expected")) / F.greatest(F.abs("value"), F.abs("expected")))
    x = x.withColumn("apart", apart).where(F.col("apart") > tolerance)
    return x.select("report_id", "metric", "section_id", "value", "expected", F.when(F.col("apart") <= close, "warning").otherwise("error").alias("severity"))


def money(text: Column) -> Column:
    """Money values of a text, unit before or after."""
    after = F.regexp_extract_all(text, F.lit(r"(?i)[0-9][0-9.,]*\s*(?:milyon|milyar)?\s*(?:TL|USD|EUR|\$|€|₺)"), F.lit(0))
    before = F.regexp_extract_all(text, F.lit(r"(?i)(?:\$|€|₺)\s*[0-9][0-9.,]*\s*(?:milyon|milyar)?"), F.lit(0))

    def value(m: Column) -> Column:
        digits = F.regexp_replace(F.regexp_extract(m, "[0-9][0-9.,]*", 0), "[.,]$", "")
        low = F.lower(m)
        return N.simple_number(digits) * F.when(low.contains("milyar"), 1e9).when(low.contains("milyon"), 1e6).otherwise(1.0)

    return F.filter(F.transform(F.array_distinct(F.concat(after, before)), value), lambda v: v.isNotNull())


def table_percentages(text: Column) -> Column:
    """Numbers of 0 to 100 in the second cell of table rows. The closing bar is left for the next row."""
    found = F.regexp_extract_all(text, F.lit(r"\|[^|\n]*\|\s*([0-9][0-9.,]*)\s*%?\s*(?=\|)"), F.lit(1))
    return F.filter(F.transform(found, lambda d: N.simple_number(F.regexp_replace(d, "[.,]$", ""))), lambda v: (v > 0) & (v <= 100))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def percentage_sums(sections: DataFrame, most: float = 105.0) -> DataFrame:
    """Sections with a table of at least three percentages that add up to more than `most`."""
    x = sections.select("report_id", "section_id", table_percentages(F.col("content")).alias("p"))
    return x.where((F.size("p") >= 3) & (total(F.col("p")) > most)).select("report_id", "section_id", F.size("p").alias("n"), F.round(total(F.col("p")), 6).alias("total"))


def value_spread(sections: DataFrame, most: float = 10_000.0) -> DataFrame:
    """Reports whose largest money value is more than `most` times the smallest above one."""
    x = sections.select("report_id", F.explode(money(F.col("content"))).alias("v")).where("v > 0")
    x = x.groupBy("report_id").agg(F.max("v").alias("largest"), F.min("v").alias("smallest"))
    return x.where((F.col("smallest") > 1) & (F.col("largest") > most * F.col("smallest")))


#: A year, unless it is an amount of money: after a currency's mark or before a unit, as `money` reads them.
YEAR = r"(?i)(?<![$€₺])(?<![$€₺]\s)\b(20[1-3][0-9])\b(?!(?:[.,][0-9]+)*\s*(?:milyon|milyar|TL|USD|EUR|\$|€|₺))"


def odd_years(sections: DataFrame, as_of: int = 2025) -> DataFrame:
    """Years ten or more before or after as_of: information and warnings. An amount of money is no year."""
    x = sections.select("report_id", F.explode(F.regexp_extract_all("content", F.lit(YEAR), F.lit(1))).alias("year")).distinct()
    year = F.col("year").cast("int")
    return x.where((year < as_of - 10) | (year > as_of + 10)).select("report_id", year.alias("year"), F.when(year < as_of - 10, "info").otherwise("warning").alias("severity"))


def margin(text: Column, keywords: list[str]) -> Column:
    return F.coalesce(*[N.simple_number(F.regexp_replace(F.nullif(F.regexp_extract(text, rf"(?iu){k}[:\s]*%?\s*([0-9.,]+)\s*%?", 1), F.lit("")), "[.,]$", "")) for k in keywords])


def margins(sections: DataFrame) -> DataFrame:
    """Reports whose net margin is above the gross margin."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "content")))
    x = sections.groupBy("report_id").agg(F.array_join(F.transform(ordered, lambda r: r["content"]), " ").alias("text"))
    x = x.select("report_id", margin(F.col("text"), K.GROSS_MARGIN).alias("gross"), margin(F.col("text"), K.NET_MARGIN).alias("net"))
    return x.where("net > gross")


def contradictions(sections: DataFrame) -> DataFrame:
    """(report_id, pair): contradicting wordings in one report."""
    any_of = lambda words: reduce(lambda a, b: a | b, [F.lower("content").contains(w) for w in words])
    said = [F.max(any_of(side).cast("int")).alias(f"s{i}{j}") for i, pair in enumerate(K.CONTRADICTIONS) for j, side in enumerate(pair)]
    x = sections.groupBy("report_id").agg(*said)
    both = F.array_compact(F.array(*[F.when((F.col(f"s{i}0") == 1) & (F.col(f"s{i}1") == 1), F.lit(i)) for i in range(len(K.CONTRADICTIONS))]))
    return x.select("report_id", F.explode(both).alias("pair"))


def realism(text: Column) -> Column:
    """Names of promises that are too good."""
    number = lambda p: F.regexp_extract(text, "(?iu)" + p, 1).try_cast("double")
    leader, growth, even = number(r"([0-9]+)\s*yıl[a-zçğıöşü]*\s*(?:içinde)?\s*(?:pazar\s*)?lider"), number(r"%\s*([0-9]+)\s*büyüme"), number(r"([0-9]+)\s*ay[a-zçğıöşü]*\s*(?:içinde\s*)?başa\s*baş")
    return F.array_compact(F.array(F.when(leader <= 1, "leader"), F.when(growth > 300, "growth"), F.when(even <= 6, "break_even")))


def rule_violations(text: Column, min_words: int = 500, min_paragraphs: int = 3, min_sources: int = 3) -> Column:
    """Names of the writing rules that a section breaks."""
    refs = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[[0-9]+\]"), F.lit(0))))
    paragraphs = F.size(F.filter(F.split(text, "\n\n"), lambda p: F.length(F.trim(p)) > 50))
    low = F.lower(text)
    banned = [F.when(low.contains(p), F.lit("banned: " + p)) for p in K.FORBIDDEN_PHRASES]
    # A statistic is unsourced if no [n] follows its first occurrence within 50 characters.
    stats = F.array_distinct(F.regexp_extract_all(text, F.lit(r"%[0-9]+|[0-9]+\s*(?:milyar|milyon|bin)"), F.lit(0)))
    unsourced = F.exists(stats, lambda s: ~F.substring(text, F.position(s, text), F.lit(50)).rlike(r"\[[0-9]+\]"))
    return F.array_compact(F.array(F.when(F.size(X.words(text)) < min_words, "words"), F.when(paragraphs < min_paragraphs, "paragraphs"), F.when(refs < min_sources, "sources"), *banned, F.when(unsourced, "unsourced")))


def quality_score(text: Column, min_words: int = 300, target_words: int = 600, paragraph_count: int = 3) -> Column:
    """0 to 1 from words, paragraphs, references, tables, lists and numbers."""
    words, refs = F.size(X.words(text)), F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[([0-9]+)\]"), F.lit(1))))
    paragraphs = F.size(F.filter(F.split(text, "\n\n"), lambda p: F.length(p) > 50))
    score = F.when(words >= target_words, 0.3).when(words >= min_words, 0.2).otherwise(0.1 * words / min_words)
    score = score + F.when(paragraphs >= paragraph_count, 0.2).otherwise(0.1 * paragraphs / paragraph_count)
    score = score + F.when(refs >= 3, 0.2).when(refs >= 1, 0.1).otherwise(0.0)
    score = score + F.when(text.contains("|") & text.contains("---"), 0.1).otherwise(0.0) + F.when(text.rlike(r"(?m)^\s*[-•*]\s+"), 0.05).otherwise(0.0)
    score = score + F.when(text.rlike("[0-9]+"), 0.075).otherwise(0.0) + F.when(text.rlike("%[0-9]+|[0-9]+%"), 0.075).otherwise(0.0)
    return F.round(F.least(score, F.lit(1.0)), 6)


def missing_sections(reports: DataFrame, sections: DataFrame) -> DataFrame:
    """(report_id, section_id) that a report of its type must have and has not."""
    needed = F.lit(None).cast("array<string>")
    for kind, names in K.REQUIRED_SECTIONS.items():
        if kind != "all":
            needed = F.when(F.col("report_type") == kind, F.array(*map(F.lit, names))).otherwise(needed)
    every = F.array(*map(F.lit, K.REQUIRED_SECTIONS["all"]))
    wanted = reports.select("report_id", F.explode(F.concat(every, F.coalesce(needed, F.array().cast("array<string>")))).alias("section_id"))
    return wanted.join(sections.select("report_id", "section_id"), ["report_id", "section_id"], "left_anti")


def report_scores(reports: DataFrame, sections: DataFrame, max_depth: int = 3) -> DataFrame:
    """(report_id, errors, warnings, infos, score): 100 less 20, 5 and 1 for each."""
    c = F.coalesce("content", F.lit(""))
    warn = (F.length(F.trim(c)) < 10).cast("int") + (F.col("level") > max_depth).cast("int")
    info = F.exists(F.split(c, "\n\n"), lambda p: F.length(p) > 2000).cast("int") + ((F.length(c) > 100) & ~c.rlike("[çğıöşüÇĞİÖŞÜ]")).cast("int")
    found = sections.select("report_id", F.lit(0).alias("e"), warn.alias("w"), info.alias("i"))
    found = found.unionByName(missing_sections(reports, sections).select("report_id", F.lit(1).alias("e"), F.lit(0).alias("w"), F.lit(0).alias("i")))
    x = found.groupBy("report_id").agg(F.sum("e").alias("errors"), F.sum("w").alias("warnings"), F.sum("i").alias("infos"))
    return x.withColumn("score", F.greatest(F.lit(0), 100 - 20 * F.col("errors") - 5 * F.col("warnings") - F.col("infos")))


def issue_scores(issues: DataFrame) -> DataFrame:
    """(report_id, errors, warnings, score, is_valid): 100 less 15 and 5 for each."""
    x = issues.groupBy("report_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    score = F.greatest(F.lit(0), 100 - 15 * F.col("errors") - 5 * F.col("warnings"))
    return x.select("*", score.alias("score"), (F.col("errors") == 0).alias("is_valid"))


def growth_rates(sections: DataFrame, high: float = 200.0, most: float = 500.0) -> DataFrame:
    """(report_id, section_id, value, severity) of rates that a growth word stands before: warnings above `high`, errors
    above `most`."""
    found = F.regexp_extract_all("content", F.lit(X.CASELESS + K.GROWTH_PATTERN), F.lit(2))
    x = sections.select("report_id", "section_id", F.explode(F.transform(found, lambda d: N.simple_number(F.regexp_replace(d, "[.,]$", "")))).alias("value"))
    return x.where(F.col("value") > high).select("report_id", "section_id", "value", F.when(F.col("value") > most, "error").otherwise("warning").alias("severity"))


def margins_out_of_range(sections: DataFrame, sector: str = "default") -> DataFrame:
    """(report_id, ratio, value, low, high) of margins outside of what is usual in a sector."""
    usual = K.SECTOR_BENCHMARKS.get(sector, K.SECTOR_BENCHMARKS["default"])
    ordered = F.array_sort(F.collect_list(F.struct("ord", "content")))
    x = sections.groupBy("report_id").agg(F.array_join(F.transform(ordered, lambda r: r["content"]), " ").alias("text"))
    rows = [F.struct(F.lit(name).alias("ratio"), margin(F.col("text"), words).alias("value"), *(F.lit(float(v)).alias(k) for k, v in zip(("low", "high"), usual[name], strict=True))) for name, words in (("gross_margin", K.GROSS_MARGIN), ("net_margin", K.NET_MARGIN))]
    return x.select("report_id", F.inline(F.array(*rows))).where((F.col("value") < F.col("low")) | (F.col("value") > F.col("high")))


def consistency_report(sections: DataFrame) -> DataFrame:
    """(report_id, text): all metrics with the value of each section, then what differs."""
    values = metrics(sections)
    line = F.concat(F.lit("  - "), "section_id", F.lit(": "), F.format_number("value", 2))
    by = values.groupBy("report_id", "metric").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))), lambda r: r["l"]), "\n").alias("lines"))
    by = by.groupBy("report_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("metric", F.lit(":\n"), "lines"))), "\n\n").alias("known"))
    odd = cross_reference(sections).select("report_id", F.concat("severity", F.lit(": "), "metric", F.lit(" "), "section_id", F.lit(" "), F.format_number("value", 2), F.lit(" / "), F.format_number("expected", 2)).alias("l"))
    odd = odd.groupBy("report_id").agg(F.array_join(F.array_sort(F.collect_list("l")), "\n").alias("odd"))
    return by.join(odd, "report_id", "left").select("report_id", F.concat_ws("\n\n", "known", "odd").alias("text"))


def disagreements(sections: DataFrame) -> DataFrame:
    """(report_id, metric, values): figures for which the sections of a report state different digits."""
    found = [F.struct(F.lit(m).alias("metric"), F.regexp_extract_all("content", F.lit(X.CASELESS + p), F.lit(1)).alias("digits")) for m, p in K.AGREED_PATTERNS.items()]
    x = sections.select("report_id", F.inline(F.array(*found))).select("report_id", "metric", F.explode("digits").alias("d"))
    x = x.select("report_id", "metric", F.regexp_replace("d", "[.,]", "").try_cast("double").alias("v")).where("v is not null")
    return x.groupBy("report_id", "metric").agg(F.array_sort(F.collect_set("v")).alias("values")).where(F.size("values") > 1)

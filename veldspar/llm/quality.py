"""Quality rules: one table of thresholds, compiled into one projection of built-in functions.

Ratios: mean word length, symbols per word, share of stop words, share of repeated lines, share of words
in repeated 8-word windows, share of lines that end in an ellipsis or begin with a bullet. A rule names a
ratio and the range it must lie in; a text is kept if every rule holds.

Repeated windows: each window gets one 64-bit hash. Windows whose hash appears once (nearly all) are
told by a hash set of plain longs; only texts with repeats sort their windows with positions.

Defined results: null and empty texts have no words, all counts 0, ratios 0; they fail the word-count
rule. Only whole texts are read. Repeated rows are judged one by one; extra columns are kept, and columns
of docs named like a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.llm._shared import carried, once, words_of

#: Words of a window whose repeats count.
WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"
# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it was on are as with be at this by an or from not have but "
    "der die das und in zu den ist von mit nicht ein eine auf für des sich dem als auch "
    "le la les de des et en un une du est pour que qui dans par sur au avec ce "
    "el los las y en que del se por con una para es al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """A ratio and the closed range in which a text passes."""

    ratio: str
    low: float = float("-inf")
    high: float = float("inf")


#: Hard rules of the contract: too few words, too many repeated words.
BASE_RULES = (Rule("n_words", low=20), Rule("repeat_percent", high=30))
#: Rules beyond those. They are wide, so that odd but clean texts pass; a symbol in ten words is the usual limit.
RULES = (
    Rule("mean_word_length", 2.0, 25.0),
    Rule("symbol_ratio", high=0.1),
    Rule("dup_line_ratio", high=0.5),
    Rule("ellipsis_line_ratio", high=0.9),
    Rule("bullet_line_ratio", high=0.95),
    Rule("stop_word_ratio", high=0.98),
)


def _part(top: Column, of: Column) -> Column:
    return F.when(of > 0, top.cast("double") / of).otherwise(0.0)


def _let(value: Column, body) -> Column:
    """body of value, which is evaluated once even where body uses it for each element of an array."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words covered by windows that the text holds twice or more."""
    n = F.size(words)
    starts = F.sequence(F.lit(1), n - (WINDOW - 1))
    windows = lambda hashes: F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))
    covered = _let(F.transform(words, lambda w: F.xxhash64(w)), lambda hashes: _let(windows(hashes), _covered))
    return F.when(n <= WINDOW, F.lit(0)).otherwise(covered).cast("long")


def _covered(windows: Column) -> Column:
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_positions(windows))


def _positions(windows: Column) -> Column:
    def among(pairs: Column) -> Column:
        same = lambda p, k: F.coalesce(F.get(pairs, k)["h"] == p["h"], F.lit(False))
        return F.filter(pairs, lambda p, k: same(p, k - 1) | same(p, k + 1))

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    at = F.sort_array(F.transform(_let(ordered, among), lambda p: p["i"]))
    start = F.struct(F.lit(0).alias("words"), F.lit(-WINDOW).alias("last"))
    fold = F.aggregate(at, start, lambda a, i: F.struct((a["words"] + F.least(F.lit(WINDOW), i - a["last"])).alias("words"), i.alias("last")))
    return fold["words"]


def lines_of(text: Column) -> Column:
    """The lines of a text that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def measures(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    """The counts of a text. words and lines are columns, so that neither is built once for each count."""
    text = F.coalesce(text, F.lit(""))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": _repeat_words(words),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long"),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)\s*$"))).cast("long"),
        "n_bullet_lines": F.size(F.filter(lines, lambda x: x.rlike(r"^\s*[-*•]\s"))).cast("long"),
    }


def ratios() -> dict[str, Column]:
    c = F.col
    return {
        "n_words": c("n_words"),
        "repeat_percent": _part(100 * c("n_repeat_words"), c("n_words")),
        "mean_word_length": _part(c("word_chars"), c("n_words")),
        "symbol_ratio": _part(c("n_symbols"), c("n_words")),
        "dup_line_ratio": _part(c("n_dup_lines"), c("n_lines")),
        "ellipsis_line_ratio": _part(c("n_ellipsis_lines"), c("n_lines")),
        "bullet_line_ratio": _part(c("n_bullet_lines"), c("n_lines")),
        "stop_word_ratio": _part(c("n_stop_words"), c("n_words")),
    }


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """True where every rule of the table holds."""
    known, out = ratios(), F.lit(True)
    for r in rules:
        x = known[r.ratio]
        if r.low > float("-inf"):
            out = out & (x >= r.low)
        if r.high < float("inf"):
            out = out & (x <= r.high)
    return out


def judge(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, keep: list[str] | None = None) -> DataFrame:
    """docs with the counts, base_failed (a rule of BASE_RULES is broken) and kept."""
    found = measures(F.col("__text"), F.col("__words"), F.col("__lines"))
    new = [*found, "base_failed", "kept"]
    kept = carried(docs, keep, new)
    x = docs.select(*kept, F.col(text_col).alias("__text"), words_of(F.col(text_col)).alias("__words"), lines_of(F.col(text_col)).alias("__lines"))
    x = once(x, found).select(*kept, *found)
    x = x.withColumn("base_failed", ~compile_rules(BASE_RULES))
    return x.withColumn("kept", ~F.col("base_failed") & compile_rules(rules))

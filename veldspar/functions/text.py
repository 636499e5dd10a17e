"""Text functions as column expressions: cleaning, splitting, tokens, stems, flags and categories.

Character classes are written out (\\p{L}, \\p{N}), because Java's \\w and \\s are ASCII unless told otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veldspar.functions import constants as K

SPACE = r"(?U)\s+"
#: Before the fixed patterns: without regard to case, and with the character classes of Unicode.
CASELESS = "(?iU)"


def clean_text(c: Column) -> Column:
    """White space to single spaces, zero-width spaces dropped, ends trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, SPACE, " "), "​", ""))


def normalize_whitespace(c: Column) -> Column:
    """Tabs to spaces, runs of spaces to one, three or more newlines to two."""
    c = F.regexp_replace(F.regexp_replace(c, "\t", " "), " +", " ")
    return F.regexp_replace(F.regexp_replace(c, "\n{3,}", "\n\n"), r"^\s+|\s+\z", "")


def truncate_text(c: Column, most: int, suffix: str = "...") -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most - len(suffix)), F.lit(suffix)))


def truncate_safe(c: Column, most: int, suffix: str = "...") -> Column:
    """Cut at the last space, if that lies beyond half of the length."""
    head = F.substring(c, 1, most - len(suffix))
    last = F.length(head) - F.locate(" ", F.reverse(head))
    fits = (F.locate(" ", head) > 0) & (last > most // 2)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.when(fits, F.substring(head, F.lit(1), last)).otherwise(head), F.lit(suffix)))


def first_sentence(c: Column, most: int = 200) -> Column:
    found = F.regexp_extract(c, r"^[^.!?]*[.!?]", 0)
    return F.when(found != "", found).otherwise(truncate_text(c, most))


def words(c: Column) -> Column:
    """Runs without white space."""
    return F.array_remove(F.split(c, SPACE), "")


def lower_words(c: Column) -> Column:
    return words(F.lower(c))


def first_lower_words(c: Column, most: int) -> Column:
    """The first of lower_words; what follows them is not split. A text that begins with white space has an empty piece before them."""
    return F.slice(F.array_remove(F.split(F.lower(c), SPACE, most + 2), ""), 1, most)


def paragraphs(c: Column, least: int = 50) -> Column:
    """Blocks between blank lines, of a trimmed length of at least least."""
    return F.filter(F.transform(F.split(c, "\n\n"), lambda x: F.trim(x)), lambda p: F.length(p) >= least)


def sentences(c: Column, least: int = 20) -> Column:
    """Split after a final mark and white space; sentences shorter than least are dropped."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda s: F.length(s) >= least)


def sentences_before_letters(c: Column) -> Column:
    """Split after a final mark and white space where a letter follows."""
    return F.filter(F.split(c, r"(?<=[.!?])\s+(?=[A-Za-zçğıöşüÇĞİÖŞÜ])"), lambda s: F.trim(s) != "")


def stem_first(c: Column, suffixes: list[str], least: int) -> Column:
    """Cut the first suffix, in the given order, that leaves more than `least` characters.

    Suffixes come longest first, so the first that fits is the longest: one expression with a shortest
    possible stem finds it. A chain of conditions would be too large a method for the JVM to compile. Words without any suffix's end,
    which are most, are told by their last letters and never reach the expression."""
    if suffixes != longest_first(suffixes):
        raise ValueError("suffixes must be given longest first")
    short = min(map(len, suffixes))
    ends = F.substring(c, -short, short).isin(sorted({x[-short:] for x in suffixes}))
    return F.when(ends & (F.length(c) > least + short), F.regexp_replace(c, rf"^(.{{{least + 1},}}?)(?:{'|'.join(suffixes)})$", "$1")).otherwise(c)


def lexical_words(c: Column) -> Column:
    """Words of the lexical index: lower case, marks to spaces, digits to NUM."""
    c = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", " ")
    return words(F.regexp_replace(c, r"\p{Nd}+", " NUM "))


def is_term(w: Column, least: int, stop: list[str]) -> Column:
    """Whether a word is long enough and no stop word. Meant for rows after an explode, where it is
    generated code with a hash set."""
    return (F.length(w) >= least) & ~w.isin(stop)


def keyword_words(c: Column) -> Column:
    """Words of keyword extraction: runs of letters. Java matches this class many times faster than its
    complement, which could be replaced instead."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-zçğıöşü]+"), F.lit(0))


def longest_first(suffixes: list[str]) -> list[str]:
    return sorted(suffixes, key=len, reverse=True)


def let(value: Column, body) -> Column:
    """body of value, which is evaluated once even where body mentions it many times."""
    return F.transform(F.array(value), body)[0]


def hits(c: Column, keywords: list[str]) -> Column:
    """How many keywords the text contains. A list keeps the generated code small, where a sum of so many
    terms would be too large for the JVM to compile."""
    return F.size(F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(c, k)))


def best_named(scores: list[tuple[str, Column]], field: str = "name") -> Column:
    """(score, name) of the largest score; ties go to the name listed first."""
    return F.array_max(F.array(*[F.struct(s.alias("score"), F.lit(-i).alias("order"), F.lit(n).alias(field)) for i, (n, s) in enumerate(scores)]))


def category(c: Column) -> Column:
    """(name, confidence) of the best category; genel with 0.5 if no keyword is found."""
    best = lambda low: best_named([(n, hits(low, k) / F.lit(float(len(k))) * F.lit(w)) for n, (w, k) in K.CATEGORIES.items()])

    def named(b: Column) -> Column:
        found = b["score"] > 0
        return F.struct(F.when(found, b["name"]).otherwise("genel").alias("name"), F.when(found, F.least(b["score"] * 2, F.lit(1.0))).otherwise(0.5).alias("confidence"))

    return let(let(F.lower(c), best), named)


def subcategory(c: Column, main: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, subs in K.SUBCATEGORIES.items():
        out = F.when(main == name, _best_hit(c, subs)).otherwise(out)
    return out


def _best_hit(c: Column, sets: dict[str, list[str]]) -> Column:
    """The first of the sets with most hits, null without any."""
    best = let(F.lower(c), lambda low: best_named([(n, hits(low, k)) for n, k in sets.items()]))
    return let(best, lambda b: F.when(b["score"] > 0, b["name"]))


def chunk_category(c: Column) -> Column:
    return _best_hit(c, K.CHUNK_CATEGORIES)


def content_type(c: Column) -> Column:
    """table, list, code or text."""
    count = lambda x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    code = c.contains("```") | (count("    ") >= 12)
    return F.when(count("|") >= 3, "table").when(c.rlike(r"(?m)^\s*[-*•]\s"), "list").when(code, "code").otherwise("text")


def is_turkish(c: Column) -> Column:
    """tr by the share of Turkish letters in the first 1000 characters, or by three of seven words."""
    sample = F.substring(c, 1, 1000)
    letters = F.length(F.regexp_replace(sample, r"[^\p{L}]", ""))
    turkish = F.length(sample) - F.length(F.regexp_replace(sample, "[çğıöşüÇĞİÖŞÜ]", ""))
    known = hits(F.lower(sample), [f" {w} " for w in ("ve", "bir", "için", "ile", "bu", "da", "de")])
    return F.when((letters > 0) & (turkish / letters > 0.01), "tr").when(known >= 3, "tr").otherwise("en")


def entities(c: Column, kind: str, most: int = 10) -> Column:
    """Distinct full matches of a class of entities, sorted, at most ten."""
    found = F.concat(*[F.regexp_extract_all(c, F.lit(CASELESS + p), F.lit(0)) for p in K.ENTITY_PATTERNS[kind]])
    return F.slice(F.array_sort(F.array_distinct(found)), 1, most)


def plain_text(c: Column) -> Column:
    """Markdown headings, bold marks and [n] references removed."""
    c = F.regexp_replace(c, r"(?m)^#+\s*", "")
    return F.regexp_replace(F.regexp_replace(c, r"\*\*", ""), r"\[[0-9]+\]", "")


def contains_injection(c: Column) -> Column:
    return c.rlike("(?i)" + "|".join(f"(?:{p})" for p in K.INJECTION_PATTERNS))


def sanitize_prompt(c: Column) -> Column:
    for p in K.INJECTION_PATTERNS:
        c = F.regexp_replace(c, "(?i)" + p, "[FILTERED]")
    c = F.replace(c, F.lit("```"), F.lit("'''"))
    return F.regexp_replace(F.replace(c, F.lit("<script"), F.lit("&lt;script")), "</script>", "&lt;/script&gt;")


def sanitize_html(c: Column) -> Column:
    """Tags dropped, then five entities decoded in order."""
    c = F.regexp_replace(c, "<[^>]+>", "")
    for entity, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"')):
        c = F.replace(c, F.lit(entity), F.lit(mark))
    return c


def token_estimate(c: Column) -> Column:
    """Tokens without a vocabulary: the larger of words * 1.5 and characters / 3.5, truncated."""
    n = F.size(words(c))
    return F.when(F.length(c) == 0, 0).otherwise(F.greatest((n * F.lit(1.5)).cast("int"), (F.length(c) / F.lit(3.5)).cast("int")))


def truncate_tokens(c: Column, most: int, suffix: str = "...") -> Column:
    """The longest beginning of a text that, with the suffix, has at most so many tokens by `token_estimate`; a text that
    fits is left as it is.

    Of n characters and w words an estimate has (int) max(1.5 * w, n / 3.5) tokens, so both are bounded; the cut never
    falls behind the space after the last word that fits, where the suffix would be a word of its own."""
    chars = -int(-3.5 * (most + 1) // 1) - 1 - len(suffix)
    words_left = -int(-(most + 1) / 1.5 // 1) - 1
    if chars <= 0 or words_left <= 0:
        return F.when(token_estimate(c) <= most, c).otherwise(F.lit(suffix))
    # Possessive, so that no place is tried twice.
    head = F.regexp_extract(c, rf"(?U)^\s*+(?:\S++\s++){{{words_left - 1}}}\S++", 0)
    fits = F.when(F.length(head) > 0, F.least(F.length(head), F.lit(chars))).otherwise(F.lit(chars))
    return F.when(token_estimate(c) <= most, c).otherwise(F.concat(F.substring(c, F.lit(1), fits), F.lit(suffix)))


def sanitize_filename(c: Column) -> Column:
    """Characters that file names cannot hold become underscores."""
    return F.translate(c, K.FILENAME_INVALID, "_" * len(K.FILENAME_INVALID))


def timed_filename(base: str, time: Column, extension: str) -> Column:
    """A file name with the second it was made in."""
    return F.concat(F.lit(base + "_"), F.date_format(time, "yyyyMMdd_HHmmss"), F.lit(extension))


def jaccard(a: Column, b: Column) -> Column:
    """Of two word arrays; 0 if either is empty."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def keyword_overlap(query: Column, text: Column) -> Column:
    """Share of the query's words that the text has."""
    query = F.array_distinct(query)
    return F.when(F.size(query) == 0, 0.0).otherwise(F.size(F.array_intersect(query, text)) / F.size(query))


def hash_embedding(c: Column) -> Column:
    """32 numbers in 0 to 1: the bytes of the text's SHA-256."""
    digest = F.sha2(c.cast("binary"), 256)
    return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substring(digest, 2 * i + 1, F.lit(2)), 16, 10).cast("double") / 255)


def path_problem(c: Column, extensions: Column | None = None, base: str | None = None) -> Column:
    """What is wrong with a path that a user gave: empty, traversal, outside of a folder, or an extension that is not
    among those allowed; null if nothing is."""
    path = F.trim(c)
    bad = F.exists(F.array(*map(F.lit, K.FORBIDDEN_PATH_PATTERNS)), lambda p: F.contains(path, p))
    out = F.when(F.coalesce(path, F.lit("")) == "", "empty").when(bad, "traversal")
    if base is not None:
        out = out.when(~path.startswith(base.rstrip("/") + "/"), "outside")
    return out if extensions is None else out.when(~F.array_contains(extensions, F.lower(F.regexp_extract(path, r"\.[^./]*$", 0))), "extension")

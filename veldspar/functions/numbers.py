"""Numbers, dates, scores and addresses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veldspar.functions import constants as K

_UNITS = "|".join(sorted(K.MULTIPLIERS, key=lambda u: (-len(u), u)))
TURKISH, US = r"^-?[0-9]{1,3}(\.[0-9]{3})*,[0-9]+$", r"^-?[0-9]{1,3}(,[0-9]{3})*\.[0-9]+$"
WHOLE_TURKISH, WHOLE_US = r"^-?[0-9]{1,3}(\.[0-9]{3})+$", r"^-?[0-9]{1,3}(,[0-9]{3})+$"
COMMA, PLAIN = r"^-?[0-9]+,[0-9]+$", r"^-?[0-9]+(\.[0-9]+)?$"
SCALED = rf"^(-?[0-9]+([.,][0-9]+)?)\s*({_UNITS})$"


def clean_number(c: Column) -> Column:
    """Currency and percent marks dropped, (x) to -x, spaces collapsed."""
    c = F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), "[₺$€£¥%]", ""), r"\s+", " "))
    return F.when(c.rlike(r"^\(.*\)$"), F.concat(F.lit("-"), F.substring(c, F.lit(2), F.length(c) - 2))).otherwise(c)


def _dotted(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def _without(c: Column, mark: str) -> Column:
    return F.replace(c, F.lit(mark), F.lit("")).try_cast("double")


def simple_number(c: Column) -> Column:
    """Seven forms in order, then the digits without separators; null if that is no number either."""
    return (
        F.when(c.rlike(TURKISH), _dotted(c)).when(c.rlike(US), _without(c, ",")).when(c.rlike(WHOLE_TURKISH), _without(c, ".")).when(c.rlike(WHOLE_US), _without(c, ","))
        .when(c.rlike(COMMA), F.replace(c, F.lit(","), F.lit(".")).try_cast("double")).when(c.rlike(PLAIN), c.try_cast("double"))
        .otherwise(F.regexp_replace(c, "[., ]", "").try_cast("double"))
    )


def parse_number(c: Column) -> Column:
    """A number with an optional unit word, or null."""
    c = clean_number(c)
    low = F.lower(c)
    unit = F.create_map(*[F.lit(x) for pair in K.MULTIPLIERS.items() for x in pair])
    scaled = F.replace(F.regexp_extract(low, SCALED, 1), F.lit(","), F.lit(".")).try_cast("double") * F.element_at(unit, F.regexp_extract(low, SCALED, 3))
    return F.when(low.rlike(SCALED), scaled).otherwise(simple_number(c))


def number_format(c: Column) -> Column:
    c = clean_number(c)
    return F.when(F.lower(c).rlike(SCALED), "multiplied").when(c.rlike(TURKISH), "turkish").when(c.rlike(US), "us").when(c.rlike(COMMA), "decimal_comma").when(c.rlike(PLAIN), "simple").otherwise("unknown")


def format_turkish(c: Column, places: int = 2) -> Column:
    """1234.56 to 1.234,56."""
    return F.translate(F.format_number(c, places), ",.", ".,")


def extract_numbers(c: Column) -> Column:
    """Numbers with a unit first, then all others, without repeats."""
    scaled = F.regexp_extract_all(c, F.lit(rf"(?i)-?[0-9]+(?:[.,][0-9]+)?\s*(?:{_UNITS})\b"), F.lit(0))
    plain = F.regexp_extract_all(c, F.lit(r"-?[0-9]{1,3}(?:[.,][0-9]{3})*[.,][0-9]+|-?[0-9]{1,3}(?:[.,][0-9]{3})+|-?[0-9]+[.,][0-9]+|-?[0-9]+"), F.lit(0))
    return F.array_distinct(F.concat(F.transform(scaled, parse_number), F.transform(plain, parse_number)))


#: A double is split at half its digits by a product with this, as Dekker's exact product does.
_SPLIT = 134_217_729.0


def fixed(c: Column, places: int) -> Column:
    """A double with as many places as C's printf gives it: rounded by its exact binary value, a true tie to the even digit. Java's
    formatter rounds the shortest decimal of a double, so that it takes 0.15 for a tie and every tie up. From 2^52 units of the last place on Java's is used."""
    x, unit = F.abs(c.cast("double")), 10**places
    scaled, high = x * float(unit), x * _SPLIT - (x * _SPLIT - x)
    # What the product lost by rounding, exactly: both halves times the unit have no more than 53 bits.
    lost = (high * float(unit) - scaled) + (x - high) * float(unit)
    low = F.floor(scaled)
    tie = scaled - low == 0.5
    units = F.when(tie & (lost > 0), low + 1).when(tie & (lost < 0), low).otherwise(F.rint(scaled).cast("long"))
    digits = F.lpad((units % unit).cast("string"), places, "0")
    shown = F.concat(F.floor(units / unit).cast("string"), F.lit("."), digits) if places else units.cast("string")
    sign = F.when(c.cast("string").startswith("-"), "-").otherwise("")
    small = F.concat(sign, shown)
    odd = F.when(x.isNull(), None).when(F.isnan(x), "nan").when(x == float("inf"), F.concat(sign, F.lit("inf")))
    return odd.when(x < float(2**52 // unit), small).otherwise(F.format_string(f"%.{places}f", c.cast("double")))


def format_size(c: Column) -> Column:
    """Bytes, KB, MB or GB with one decimal."""
    x = c.cast("double")
    rest = lambda d, u: F.concat(F.format_string("%.1f", F.bround(x / d, 1)), F.lit(u))
    return F.when(c < 1024, F.concat(c.cast("long").cast("string"), F.lit(" B"))).when(c < 1024**2, rest(1024.0, " KB")).when(c < 1024**3, rest(1024.0**2, " MB")).otherwise(rest(1024.0**3, " GB"))


def format_duration(seconds: Column) -> Column:
    """Seconds, minutes or hours with one decimal."""
    shown = lambda x, unit: F.concat(F.format_string("%.1f", F.bround(x, 1)), F.lit(unit))
    x = seconds.cast("double")
    return F.when(x < 60, shown(x, "s")).when(x < 3600, shown(x / 60, "m")).otherwise(shown(x / 3600, "h"))


def clamp(score: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), score))


def weighted_average(scores: Column, weights: Column | None = None) -> Column:
    """Of two arrays of one length; 0 for no scores or no weight, null if the lengths differ."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    if weights is None:
        return F.when(F.size(scores) == 0, 0.0).otherwise(total(scores) / F.size(scores))
    share = total(F.zip_with(scores, weights, lambda a, b: a * b)) / F.nullif(total(weights), F.lit(0.0))
    return F.when(F.size(scores) == 0, 0.0).when(F.size(scores) == F.size(weights), F.coalesce(share, F.lit(0.0)))


def recency(age_days: Column) -> Column:
    """Score of an age in days; 0.5 if unknown."""
    out = F.when(age_days.isNull(), 0.5)
    for limit, score in ((30, 1.0), (180, 0.9), (365, 0.8), (730, 0.6), (1825, 0.4)):
        out = out.when(age_days < limit, score)
    return out.otherwise(0.2)


def domain(url: Column) -> Column:
    return F.split_part(F.replace(F.regexp_replace(url, "^https?://", ""), F.lit("www."), F.lit("")), F.lit("/"), F.lit(1))


def credibility(host: Column, kind: Column | None = None) -> Column:
    """Of the longest listed suffix that the domain ends in, at a dot; 0.5 if none does."""
    out = F.lit(0.5)
    for suffix, score in sorted(K.CREDIBILITY.items(), key=lambda x: (len(x[0]), x[0])):
        out = F.when((host == suffix) | host.endswith("." + suffix), score).otherwise(out)
    return out if kind is None else F.when(kind == "file", 0.8).when(kind == "user", 0.7).otherwise(out)


def confidence(relevance: Column, trust: Column, age: Column) -> Column:
    return F.bround(F.lit(0.4) * relevance + F.lit(0.4) * trust + F.lit(0.2) * age, 3)


def real_rate(nominal: Column, inflation: Column) -> Column:
    """Fisher's real rate in percent."""
    return F.bround(((1 + nominal / 100) / (1 + inflation / 100) - 1) * 100, 2)


def quality_level(score: Column) -> Column:
    return F.when(score >= 0.9, "excellent").when(score >= 0.7, "high").when(score >= 0.5, "medium").otherwise("low")

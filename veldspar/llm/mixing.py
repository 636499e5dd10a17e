"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations alone.

A source's target is its weight's share of all words, capped at MAX_REPEATS times the words the source
has; what caps cut off is shared again by weight. Every document is then taken floor(target / source
words) times for certain. The words still missing, R, come from one more sample without replacement with
inclusion probabilities proportional to size: p = L * size, where documents of L * size >= 1 are taken for
certain and L is such that the others' expected words, L * sum of size^2, are what those leave of R. So the
expected words are R. The others are ranked by Pareto's variable, the random odds u / (1 - u) divided by the
inclusion odds p / (1 - p). The sample's size is fixed in words, not in documents, since words are what a
target counts: the ranking is followed until R words are reached, to within half of the last document.
Against a sample of a fixed number of documents this shifts inclusion by what one document more or less does.

A hot source is never ranked in one task: words are first added up by 4096 slices of the ranking, and
only the rows of the one slice that the cut falls into are ranked one by one. The documents taken for certain
are found from the distinct sizes of a source.

Defined results: null texts have size 0; documents of size 0 are never taken. A null source is a source,
last in order. The random number of a row is a hash of all its columns, so reruns agree, and rows that
differ anywhere are drawn apart. Rows that are equal in all columns share a place in the ranking; where the
cut falls among them, as many are taken as it asks for, whichever, as nothing tells them apart. An empty
table gives an empty result. Extra columns are kept, and columns of docs named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veldspar.llm._shared import carried, materialise, once, words_of

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SLICES = 4096
SEED = 20231


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.size(words_of(text)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """sizes(source, source_size) with the target of each source.

    The reshared level L satisfies sum(min(cap, weight * L)) = total. Sources are ordered by
    cap / weight; one is capped if the level left by those before it reaches its own, and the first that is
    not sets the level. Without one, every source is capped."""
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int"))
    x = sizes.withColumn("weight", weight).withColumn("cap", F.lit(float(max_repeats)) * F.col("source_size"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(1))
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    x = x.withColumn("level", left / F.sum("weight").over(after)).withColumn("capped", F.col("cap") / F.col("weight") <= F.col("level"))
    first = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(every)
    return x.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * first["level"]).alias("target"))


def row_hash(docs: DataFrame, seed: int, of: list[str] | None = None) -> Column:
    """A hash of the columns of a row, all if None; columns that hold maps, which have no hash, count by their text."""
    fields = docs.select(*(f"`{c}`" for c in (docs.columns if of is None else of))).schema.fields
    plain = [F.col(f"`{f.name}`").cast("string") if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in fields]
    return F.xxhash64(F.lit(seed), *plain)


def uniform(drawn: Column) -> Column:
    """A number in (0, 1) from a hash."""
    return (drawn.bitwiseAND((1 << 52) - 1).cast("double") + 0.5) / float(1 << 52)


def _by_source(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """left(source) with the columns of right, which has a row a source; null is a source."""
    renamed = right.withColumnRenamed("source", "__s")
    return left.join(renamed, F.col("source").eqNullSafe(F.col("__s")), how).drop("__s")


def certain_sizes(sizes: DataFrame, missing: DataFrame) -> DataFrame:
    """(source, level, least): of sizes(source, size, rows) and missing(source, missing), the factor of the
    inclusion probabilities and the largest size that is not taken for certain (null if none is missing)."""
    x = _by_source(sizes.where("size > 0"), missing, "inner").where("missing > 0")
    down = Window.partitionBy("source").orderBy(F.desc("size"))
    squares = F.col("rows") * F.col("size").cast("double") * F.col("size")
    above = F.coalesce(F.sum(F.col("rows") * F.col("size")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = (F.col("missing") - above) / F.sum(squares).over(down.rowsBetween(0, Window.unboundedFollowing))
    x = x.select("source", "size", level.alias("level")).where(F.col("level") * F.col("size") < 1)
    return x.groupBy("source").agg(F.max(F.struct("size", "level")).alias("m")).select("source", F.col("m.level").alias("level"), F.col("m.size").alias("least"))


def _repeated(rows: DataFrame, times: str) -> DataFrame:
    """Each row as often as a column says, in two steps, so that not all repeats of a row are made by one task."""
    x = rows.where(F.col(times) > 0).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / SLICES))).alias("__nth")).repartition("__drawn", "__nth")
    return x.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(SLICES), F.col(times) - F.col("__nth") * SLICES))))


def mix(docs: DataFrame, text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED, keep: list[str] | None = None, drawn_by: list[str] | None = None) -> DataFrame:
    """docs with size, source_size, target, copies (times the document is taken) and taken (words). drawn_by
    names the columns that a row's random number depends on, all if None."""
    new = ["size", "source_size", "target", "copies", "taken"]
    kept = carried(docs, keep, new)
    drawn = row_hash(docs, seed, drawn_by)

    def keyed(columns: list[str]) -> DataFrame:
        # Carried columns travel as one, so that no name of theirs clashes with the plan's.
        row = [F.struct(*(F.col(f"`{c}`") for c in columns)).alias("__row")] if columns else []
        x = docs.select(*row, F.col(source_col).alias("source"), F.col(text_col).alias("__text"), drawn.alias("__drawn"))
        return once(x, {"size": word_count(F.col("__text"))}).drop("__text")

    slim = keep is not None and text_col not in kept
    rows = materialise(keyed(kept), "mix") if slim else keyed(kept)
    small = rows.select("source", "size", "__drawn") if slim else materialise(keyed([]), "mix")
    sizes = materialise(small.groupBy("source", "size").agg(F.count(F.lit(1)).alias("rows")), "mix-sizes")
    totals = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = targets(totals, weights, max_repeats).withColumn("whole", whole).withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = materialise(plan, "mix-targets")
    plan = materialise(_by_source(plan, certain_sizes(sizes, plan.select("source", "missing"))), "mix-plan")

    # The variable q = (u / (1-u)) * ((1-p) / p) lies in [0, inf); q / (1 + q) orders alike in [0, 1).
    p, u = F.col("level") * F.col("size"), uniform(F.col("__drawn"))
    q = u / (1 - u) * (1 - p) / p
    certain, ranks = F.coalesce(F.col("size") > F.col("least"), F.lit(False)), (F.col("size") > 0) & (F.col("size") <= F.col("least"))

    def ranked(left: DataFrame, cuts: DataFrame) -> DataFrame:
        x = _by_source(left, cuts).withColumn("certain", certain).withColumn("place", F.when(ranks, q / (1 + q)))
        return x.withColumn("slice", F.floor(F.col("place") * SLICES).cast("int"))

    first = ranked(small, plan).where("certain or place is not null").groupBy("source", "missing", F.coalesce("slice", F.lit(-1)).alias("slice")).agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    slices = first.withColumn("upto", F.sum("words").over(upto)).where("slice >= 0")
    # The slice in which the running words first reach what is missing.
    edge = slices.where("upto >= missing").groupBy("source").agg(F.min(F.struct("slice", (F.col("upto") - F.col("words")).alias("before"))).alias("edge"))
    edge = edge.select("source", F.col("edge.slice").alias("edge_slice"), F.col("edge.before").alias("before"))
    plan = materialise(_by_source(plan, edge), "mix-edges")
    # Equal rows are one entry with a number of rows, so that no row that is repeated fills a task.
    near = ranked(small, plan).where("slice = edge_slice").groupBy("source", "place", "size", "__drawn", "before", "missing").agg(F.count(F.lit(1)).alias("rows"))
    run = Window.partitionBy("source").orderBy("place", "size", "__drawn").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("before", F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("rows")).over(run), F.lit(0)))
    # Of the rows of an entry those are taken whose middle lies before the cut.
    fit = F.least(F.col("rows"), F.floor((F.col("missing") - F.col("before")) / F.col("size") + 0.5)).cast("long")
    last = near.withColumn("fit", fit).where("fit > 0").groupBy("source").agg(F.max(F.struct("place", "size", "__drawn", "fit", "rows")).alias("last"))
    cuts = materialise(_by_source(plan, last).withColumn("parted", F.coalesce(F.col("last.fit") < F.col("last.rows"), F.lit(False))), "mix-cuts")

    final = ranked(rows, cuts)
    before = F.struct("place", "size", "__drawn")
    upto = F.struct(F.col("last.place").alias("place"), F.col("last.size").alias("size"), F.col("last.__drawn").alias("__drawn"))
    within = F.col("edge_slice").isNull() | (F.col("slice") < F.col("edge_slice")) | ((F.col("slice") == F.col("edge_slice")) & (before <= upto))
    extra = F.col("certain") | (F.col("place").isNotNull() & F.coalesce(within, F.lit(False)))
    made = final.withColumn("extra", extra.cast("long")).withColumn("split", F.col("parted") & F.coalesce(before == upto, F.lit(False)))
    if not cuts.where("parted").isEmpty():
        # At most one row of each source, with all its repeats, is cut in two: it is counted and written out anew.
        one = [F.first("__row").alias("__row")] if kept else []
        parted = made.where("split").groupBy("__drawn", "source", "size", "source_size", "target", "whole").agg(*one, F.first("last.fit").alias("fit"), F.count(F.lit(1)).alias("rows"))
        part = lambda extra, times: F.struct(F.lit(extra).cast("long").alias("extra"), times.alias("times"))
        parted = parted.select("*", F.inline(F.array(part(1, F.col("fit")), part(0, F.col("rows") - F.col("fit")))))
        columns = [*(["__row"] if kept else []), "size", "source_size", "target", "whole", "extra"]
        made = made.where("not split").select(*columns).unionByName(_repeated(parted, "times").select(*columns))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("extra")).otherwise(0).cast("long")
    return made.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies")).select(*(["__row.*"] if kept else []), *new)

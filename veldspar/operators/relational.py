"""Relational operators that Spark has no single call for: as-of and range joins, sessions, top rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veldspar.operators.scratch import materialise


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the last right row of its key that is not later. Both sides are put
    in one sequence by key and time, and the last right value is carried forward: one shuffle, no join."""
    a = left.select("*", F.col(left_time).alias("__t"), F.lit(1).alias("__side"), *[F.lit(None).cast(dict(right.dtypes)[v]).alias(f"__{v}") for v in values])
    b = right.select(F.col(key), F.col(right_time).alias("__t"), F.lit(0).alias("__side"), *[F.col(v).alias(f"__{v}") for v in values])
    w = Window.partitionBy(key).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True)
    carried = both.select("*", *[F.last(F.col(f"__{v}"), ignorenulls=True).over(w).alias(f"asof_{v}") for v in values])
    return carried.where("__side = 1").select(*left.columns, *[f"asof_{v}" for v in values])


#: Points of a part of a bin, for each range of it and at least, ranges of a part, and pairs of a task, about; tasks of a join at most.
POINTS_A_RANGE, POINTS, RANGES, PAIRS, TASKS = 4, 20_000, 200_000, 50_000_000, 20_000


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Points with every range [low, high) that holds them, by an equi-join on bins of the given width.

    The points and the ranges of a bin of many are cut into parts by a hash, and every part of points meets every part of ranges; parts are so
    large that the ranges' copies are no more than a share of the points. The ranges of a task are held in a hash table that points pass by, so no pairs are sorted or spilled,
    and tasks are as many as the pairs ask for. Points and ranges are each put in order in their task, so points that follow each other come out with much the same
    ranges: pairs grow by the product of both sides, and written in that order they take a fraction of the space."""
    spark = points.sparkSession
    bins = F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))
    r = ranges.select("*", F.explode(bins).alias("__bin"))
    p = points.withColumn("__bin", F.floor(F.col(point) / width))
    count = lambda x, n: x.groupBy("__bin").agg(F.count(F.lit(1)).alias(n))
    parts = {"__ps": F.ceil(F.col("__p") / F.greatest(F.lit(POINTS), POINTS_A_RANGE * F.col("__r"))).cast("int"), "__rs": F.ceil(F.col("__r") / RANGES).cast("int")}
    sizes = materialise(count(p, "__p").join(count(r, "__r"), "__bin").withColumns(parts), "range-bins")
    pairs = sizes.agg(F.sum(F.col("__p").cast("double") * F.col("__r")).alias("n")).first().n or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(int(pairs / PAIRS), TASKS))
    cut = sizes.select("__bin", "__ps", "__rs")
    own = lambda x, n: F.pmod(F.xxhash64(*x.columns), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    p = p.join(cut, "__bin").withColumn("__pp", own(points, "__ps")).withColumn("__rp", every("__rs")).drop("__ps", "__rs")
    r = r.join(cut, "__bin").withColumn("__rp", own(ranges, "__rs")).withColumn("__pp", every("__ps")).drop("__ps", "__rs")
    dealt = ["__bin", "__pp", "__rp"]
    # Spark drops an order below a join from the plan, unless a condition that is not deterministic stands between.
    ordered = lambda x, by: x.repartition(tasks, *dealt).sortWithinPartitions(*dealt, by).where(F.monotonically_increasing_id() >= 0)
    x = ordered(p, point).join(ordered(r, low).hint("shuffle_hash"), dealt)
    return x.where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop(*dealt)


#: Rows of a bin that are joined in one task, about.
BIN_ROWS = 20_000


def overlap_join(left: DataFrame, right: DataFrame, low: str, high: str, right_low: str, right_high: str, width: float, on: list[tuple[str, str]] | None = None, rows: int = BIN_ROWS) -> DataFrame:
    """Pairs of left and right rows whose intervals [low, high) overlap, within equal keys `on` (left name, right name) if given.

    Both sides are dealt to the bins of the given width that their intervals touch, and a pair comes out in the first bin that
    both have, so each pair comes once. Keys with no more than `rows` pairs of rows have a single bin. A bin of more than `rows` rows on a side is cut into parts by a hash of the row, and every part of one
    side meets every part of the other, so no task gets a whole hot bin. Intervals that are empty, backward or null overlap with none; a width near the usual
    length of an interval keeps the copies few. Columns of both sides must differ in name."""
    on = on or []
    number = lambda c: F.col(c).cast("timestamp").cast("double") if "timestamp" in kinds[c] or kinds[c] == "date" else F.col(c).cast("double")
    kinds = dict([*left.dtypes, *right.dtypes])

    equal = [f"__key{i}" for i in range(len(on))]
    keyed = lambda x, a, b, names: x.where(F.col(a) < F.col(b)).withColumns(dict(zip(equal, map(F.col, names), strict=True)))

    def binned(x: DataFrame, a: str, b: str, side: str) -> DataFrame:
        first, last = F.floor(number(a) / width), F.ceil(number(b) / width) - 1
        if on:
            x = x.join(hot, equal, "left")
            first, last = (F.when(F.col("__hot"), c).otherwise(0) for c in (first, last))
        x = x.withColumn(f"__{side}_first", first)
        return x.withColumn("__bin", F.explode(F.sequence(F.col(f"__{side}_first"), F.greatest(F.col(f"__{side}_first"), last)))).drop("__hot")

    a, b = keyed(left, low, high, [p[0] for p in on]), keyed(right, right_low, right_high, [p[1] for p in on])
    if on:
        # Keys of few pairs have one bin, so their rows aren't copied.
        count = lambda x, n: x.groupBy(*equal).agg(F.count(F.lit(1)).alias(n))
        hot = materialise(count(a, "__l").join(count(b, "__r"), equal).where(F.col("__l") * F.col("__r") > rows).select(*equal, F.lit(True).alias("__hot")), "overlap-keys")
    a, b = binned(a, low, high, "l"), binned(b, right_low, right_high, "r")
    keys = ["__bin", *equal]
    parts = lambda x, n: x.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(n))
    # Only bins that both sides have more than a part of rows in; what is not there has one part.
    cut = materialise(parts(a, "__l").join(parts(b, "__r"), keys).where("__l > 1 or __r > 1"), "overlap-bins")
    one = lambda c: F.coalesce(F.col(c), F.lit(1))
    spread = lambda n: F.explode(F.sequence(F.lit(0), one(n) - 1))
    salt = lambda x, n: F.pmod(F.xxhash64(*x.columns), one(n)).cast("int")
    a = a.join(cut, keys, "left").withColumn("__lp", salt(left, "__l")).withColumn("__rp", spread("__r")).drop("__l", "__r")
    b = b.join(cut, keys, "left").withColumn("__rp", salt(right, "__r")).withColumn("__lp", spread("__l")).drop("__l", "__r")
    met = a.join(b, [*keys, "__lp", "__rp"]).where((F.col(low) < F.col(right_high)) & (F.col(right_low) < F.col(high)) & (F.col("__bin") == F.greatest("__l_first", "__r_first")))
    return met.select(*left.columns, *right.columns)


def sessions(events: DataFrame, key: str, time: str, gap_seconds: int) -> DataFrame:
    """(key, session_start, session_end, n): runs of events less than the gap apart."""
    w = Window.partitionBy(key).orderBy(time)
    seconds = F.col(time).cast("timestamp").cast("double")
    new = F.when(seconds - F.lag(seconds).over(w) < gap_seconds, 0).otherwise(1)
    x = events.withColumn("__new", new).withColumn("__session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(key, "__session").agg(F.min(time).alias("session_start"), F.max(time).alias("session_end"), F.count(F.lit(1)).alias("n")).drop("__session")


def top_per_group(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def ordinal(rows: DataFrame, order: list[Column | str], name: str = "n") -> DataFrame:
    """rows numbered 1, 2, ... in the given total order, without one task seeing them all: rows are split by
    ranges of the order, numbered within their range, and moved up by the sizes of the ranges before."""
    split = materialise(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ordinal")
    sizes = split.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    before = F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__start"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return split.withColumn("__own", own).join(starts, "__part").withColumn(name, F.col("__start") + F.col("__own")).drop("__part", "__own", "__start")


def tables(spark, sf_dir: str, names=("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")) -> None:
    """Temporary views of the tables, so that plans can be written as SQL."""
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)

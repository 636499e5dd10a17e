"""Mergeable sketches: one row of sketches for each group and day, kept in a table and merged by union for any longer span.

HLL counts distinct values within about 1.04 / sqrt(2^LG_HLL); a theta sketch counts them exactly up to 2^LG_THETA and also answers
intersections and differences (sketches of cells of keys are exact whatever the number of keys: `cells_of`); KLL answers quantiles within a rank error of about 1.7 / K. Sketches are built once, in one
pass with partial aggregation; later questions read the sketches, not the rows. Nulls are not counted; a group of nulls alone has
empty sketches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_HLL, LG_THETA, K = 14, 14, 400
#: Bounds that hold for three standard deviations: of a KLL rank, and of an HLL count as a share of it.
RANK_ERROR, COUNT_ERROR = 3 * 1.7 / K, 3 * 1.04 / 2 ** (LG_HLL / 2)


def sketched(rows: DataFrame, groups: list[str], day: Column, key: str, value: str) -> DataFrame:
    """(groups, day, n, hll, theta, kll): rows, distinct keys twice, and the distribution of a value."""
    return rows.groupBy(*groups, day.alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(F.col(key), LG_HLL).alias("hll"), F.theta_sketch_agg(F.col(key), LG_THETA).alias("theta"), F.kll_sketch_agg_double(F.col(value).cast("double"), K).alias("kll")
    )


def merged(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """The sketches of days put together by groups; no groups for one row of all."""
    return sketches.groupBy(*groups).agg(F.sum("n").alias("n"), F.hll_union_agg("hll").alias("hll"), F.theta_union_agg("theta", LG_THETA).alias("theta"), F.kll_merge_agg_double("kll").alias("kll"))


def answered(sketches: DataFrame, groups: list[str], shares: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """(groups, n, distinct_hll, distinct_theta, quantiles) of sketches."""
    quantiles = F.array(*(F.kll_sketch_get_quantile_double("kll", F.lit(s)) for s in shares))
    return sketches.select(*groups, "n", F.hll_sketch_estimate("hll").alias("distinct_hll"), F.round(F.theta_sketch_estimate("theta")).cast("long").alias("distinct_theta"), quantiles.alias("quantiles"))


def cells_of(rows: DataFrame, key: str) -> int:
    """Cells that keys are dealt to by a hash so that no theta sketch of a cell gets more keys than it holds: half as many are meant for each,
    of which neither the hash nor the estimate of all keys is off by as much again."""
    told = rows.agg(F.hll_sketch_estimate(F.hll_sketch_agg(F.col(key), LG_HLL)).alias("n")).first().n
    return max(1, -(-int(told or 0) // 2 ** (LG_THETA - 1)))


def celled(rows: DataFrame, groups: list[str], day: Column, key: str, cells: int) -> DataFrame:
    """(groups, day, cell, n, theta): rows and distinct keys of each cell of keys, for counts that are exact at any size."""
    cell = F.pmod(F.xxhash64(F.col(key)), F.lit(cells)).cast("int")
    return rows.groupBy(*groups, day.alias("day"), cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.theta_sketch_agg(F.col(key), LG_THETA).alias("theta"))


def merged_cells(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """The sketches of days put together by groups and cells."""
    return sketches.groupBy(*groups, "cell").agg(F.sum("n").alias("n"), F.theta_union_agg("theta", LG_THETA).alias("theta"))


def distinct_in_cells(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, n, distinct_theta) of sketches of cells."""
    return sketches.groupBy(*groups).agg(F.sum("n").alias("n"), F.sum(F.round(F.theta_sketch_estimate("theta")).cast("long")).alias("distinct_theta"))


def overlaps_in_cells(sketches: DataFrame, pairs: DataFrame, group: str) -> DataFrame:
    """overlaps of sketches of cells: cells meet by their number, and a cell that one side lacks counts for the other alone."""
    side = lambda c, own: pairs.join(sketches.select(F.col(group).alias(own), "cell", "theta"), own).select("a", "b", "cell", F.col("theta").alias(f"theta_{c}"))
    count = lambda c: F.round(F.theta_sketch_estimate(c)).cast("long")
    x = side("a", "a").join(side("b", "b"), ["a", "b", "cell"], "full")
    one = F.coalesce(count("theta_a"), count("theta_b"))
    two = F.col("theta_a").isNotNull() & F.col("theta_b").isNotNull()
    return x.groupBy("a", "b").agg(
        F.sum(F.when(two, count(F.theta_intersection("theta_a", "theta_b"))).otherwise(0)).alias("both"),
        F.sum(F.when(two, count(F.theta_union("theta_a", "theta_b", LG_THETA))).otherwise(one)).alias("either"),
        F.sum(F.when(two, count(F.theta_difference("theta_a", "theta_b"))).otherwise(F.coalesce(count("theta_a"), F.lit(0)))).alias("only_a"),
    )


def overlaps(sketches: DataFrame, pairs: DataFrame, group: str) -> DataFrame:
    """(a, b, both, either, only_a): distinct keys of pairs(a, b) of groups, from sketches that are merged to one row a group."""
    side = lambda c: sketches.select(F.col(group).alias(c), F.col("theta").alias(f"theta_{c}"))
    count = lambda c: F.round(F.theta_sketch_estimate(c)).cast("long")
    return pairs.join(side("a"), "a").join(side("b"), "b").select(
        "a", "b", count(F.theta_intersection("theta_a", "theta_b")).alias("both"), count(F.theta_union("theta_a", "theta_b", LG_THETA)).alias("either"), count(F.theta_difference("theta_a", "theta_b")).alias("only_a")
    )

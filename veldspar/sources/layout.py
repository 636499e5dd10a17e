"""Tables laid out in folders by a column, so that queries read only the folders that they can need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a folder's file, about.
ROWS = 1_000_000


def write_by(rows: DataFrame, path: str, by: str, value: Column, sort: list[str] | None = None, per_file: int = ROWS) -> None:
    """Write rows in folders `by=value`, in files of about per_file rows. Rows are dealt out by the value and, where a value has many, by a
    hash of the row, so that a hot value is written by many tasks and a small one in one file; each task sorts by `sort`, which makes row groups that can be skipped."""
    made = rows.withColumn(by, value)
    n = made.groupBy(F.col(by).alias("__by")).agg(F.ceil(F.count(F.lit(1)) / per_file).cast("int").alias("__files"))
    cut = made.join(n, F.col(by).eqNullSafe(F.col("__by")), "left").drop("__by")
    dealt = cut.withColumn("__file", F.pmod(F.xxhash64(*rows.columns), F.col("__files"))).repartition(by, "__file")
    dealt.sortWithinPartitions(by, *(sort or [])).drop("__files", "__file").write.option("maxRecordsPerFile", per_file).partitionBy(by).mode("overwrite").parquet(path)


def read_by(spark: SparkSession, path: str, chosen: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """The table, or its rows whose folders are among chosen(by): Spark finds those at run time and reads no other folder."""
    rows = spark.read.parquet(path)
    return rows if chosen is None else rows.join(F.broadcast(chosen.select(by).distinct()), by, "left_semi")

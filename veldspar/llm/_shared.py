"""Helpers that several corpus operators use: scratch tables and word rules."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldspar.operators.scratch import discard, materialise, scratch_path

__all__ = ["HOT_ROWS", "SPACE", "carried", "discard", "hot_keys", "id_remainder", "look_up", "materialise", "materialise_bucketed", "once", "read", "row_key", "scratch_path", "words_of"]

#: White space that separates words: U+0020 and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"


def materialise_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """As materialise, laid out in buckets of key, so that grouping by key later moves nothing. The table's name is
    dropped at once; its files stay for the frame."""
    spark = df.sparkSession
    table, path = f"veldspar_{uuid.uuid4().hex}", scratch_path(spark, name)
    df.write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(table)
    out = spark.table(table).select(*df.columns)
    spark.sql(f"DROP TABLE {table}")
    return out


#: Rows of one key from which it is looked up without a shuffle.
HOT_ROWS = 100_000


def hot_keys(rows: DataFrame, key: str, hot: int | None = None) -> DataFrame:
    """The keys that more than hot rows have: no more than rows / hot."""
    return rows.groupBy(key).count().where(F.col("count") > (HOT_ROWS if hot is None else hot)).select(key)


def look_up(rows: DataFrame, table: DataFrame, key: str, columns: list[str], spread: Column, hot: DataFrame) -> DataFrame:
    """rows with columns of table, which has one row a key (null where it has none). Keys in hot, whose number
    is bounded by the rows they have, are broadcast; their rows then take part in the join by a key of their own,
    made of spread, so that no task gets all rows of a key."""
    near = table.join(F.broadcast(hot), key, "left_semi").select(F.col(key), F.struct(*columns).alias("__near"))
    x = rows.join(F.broadcast(near), key, "left")
    own = F.when(F.col("__near").isNull(), F.col(key)).otherwise(F.xxhash64(spread))
    far = table.select(F.col(key).alias("__own"), F.struct(*columns).alias("__far"))
    x = x.withColumn("__own", own).join(far, "__own", "left").withColumn("__found", F.coalesce("__near", "__far"))
    return x.select(*rows.columns, *(F.col("__found")[c].alias(c) for c in columns))


def row_key(df: DataFrame) -> Column:
    """A struct of two 64-bit hashes (a, b) over all columns of a row; columns that hold maps, which have no hash,
    count by their text, and nulls by their place."""
    def part(f: T.StructField) -> list[Column]:
        c = F.col(f"`{f.name}`")
        return [c.cast("string") if "map<" in f.dataType.simpleString() else c, c.isNull()]

    values = [x for f in df.schema.fields for x in part(f)]
    return F.struct(F.xxhash64(F.lit(1), *values).alias("a"), F.xxhash64(F.lit(2), *values).alias("b"))


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that are computed once a row: a generator of one row stands between them and what
    follows, so that filters on them are not moved below, where each mention would be computed anew."""
    held = df.select("*", F.struct(*(c.alias(n) for n, c in columns.items())).alias("__once"))
    return held.select(*df.columns, F.inline(F.array("__once")))


def carried(docs: DataFrame, keep: list[str] | None, new) -> list[str]:
    """The columns that an operator carries along: those asked for (all if None) without its own results,
    whose names are told apart as Spark does, without regard to case."""
    own = {n.lower() for n in new}
    return [c for c in (docs.columns if keep is None else keep) if c.lower() not in own]


def words_of(text: Column) -> Column:
    """The words of a text, an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def id_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text modulo n; a null id has remainder null."""
    return F.crc32(doc_id.cast("string")) % n


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")

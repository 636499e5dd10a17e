"""JSON columns as typed variants: values keep their kinds, are taken out by path, and the shapes that occur are told."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parsed(rows: DataFrame, column: str, name: str = "variant") -> DataFrame:
    """rows with the column's JSON as a variant; null where it is null or no JSON."""
    return rows.withColumn(name, F.try_parse_json(F.col(f"`{column}`")))


def typed(rows: DataFrame, variant: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """rows with a column for each name of fields: (path, type); null where the path is not there or its value is not of the type."""
    return rows.withColumns({name: F.try_variant_get(F.col(variant), path, kind) for name, (path, kind) in fields.items()})


def shapes(rows: DataFrame, variant: str, groups: list[str]) -> DataFrame:
    """(groups, n, bad, shape): rows, rows without a variant, and the schema that all variants of a group fit in."""
    bad = F.count_if(F.col(variant).isNull()).alias("bad")
    return rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), bad, F.schema_of_variant_agg(F.col(variant)).alias("shape"))


def entries(rows: DataFrame, variant: str, keep: list[str]) -> DataFrame:
    """(keep, name, kind, value): a row for each field of an object, with the kind of its value and the value as JSON."""
    tvf = rows.sparkSession.tvf
    x = rows.select(*keep, variant).lateralJoin(tvf.variant_explode(F.col(variant).outer()))
    return x.select(*keep, F.col("key").alias("name"), F.schema_of_variant(F.col("value")).alias("kind"), F.to_json(F.col("value")).alias("value"))

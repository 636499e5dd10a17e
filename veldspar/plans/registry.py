"""Registered queries by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


#: Tables of texts, whose rows cost much more than their bytes.
TEXTS = ("documents", "pages")
#: Bytes up to which a table may be a single row group, and so a single task.
SMALL = 128 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. A small table of texts is dealt out to all cores first; larger ones are split as they are read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in TEXTS and df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= SMALL:
        return df.repartition(spark.sparkContext.defaultParallelism)
    return df


def quoted(values) -> str:
    """A SQL list of string literals."""
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def value_rows(rows) -> str:
    """SQL rows for VALUES."""
    one = lambda v: "NULL" if v is None else f"{v!r}::DOUBLE" if isinstance(v, float) else str(v) if isinstance(v, int) else quoted([v])
    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)

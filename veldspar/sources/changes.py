"""Tables that change: a log of upserts and deletes by key, read as of any version, and compaction.

Each change is a folder `version=N` of Parquet files whose rows have the table's columns and `__op` (upsert or delete). A version
counts once its folder has Spark's _SUCCESS mark, so a change that dies half-way is never read. A snapshot takes the newest row of
each key up to its version and drops those that were deleted: one shuffle by key, with a partial aggregation before it. Compaction writes a
snapshot as `base=N`; later snapshots start there and read only the versions after it, earlier ones stay readable until `vacuum`.

Defined results: of several rows of one key in one change, the greatest by all columns counts; deleting a key that is not there changes
nothing; a null key is a key. One writer at a time: a second writer of the same version finds its folder and fails.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ChangeTable:
    """A table of the given schema and key in a folder."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: T.StructType):
        self.spark, self.path, self.key, self.schema = spark, path.rstrip("/"), key, schema

    def _folders(self, kind: str) -> list[int]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        done = [n for n in names if re.fullmatch(rf"{kind}=\d+", n) and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n.partition("=")[2]) for n in done)

    def versions(self) -> list[int]:
        return self._folders("version")

    def _write(self, rows: DataFrame, op: str) -> int:
        version = max([*self.versions(), *self._folders("base")], default=0) + 1
        rows.withColumn("__op", F.lit(op)).write.parquet(f"{self.path}/version={version}")
        return version

    def upsert(self, rows: DataFrame) -> int:
        """New rows and new states of rows, by key; returns the version."""
        return self._write(rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema.fields)), "upsert")

    def delete(self, keys: DataFrame) -> int:
        """Tombstones for the keys of a frame with the key column."""
        kinds = {f.name: f.dataType for f in self.schema.fields}
        return self._write(keys.select(*((F.col(f"`{n}`") if n == self.key else F.lit(None)).cast(t).alias(n) for n, t in kinds.items())).distinct(), "delete")

    def snapshot(self, version: int | None = None) -> DataFrame:
        """The rows as of a version, the last if None."""
        versions, bases = self.versions(), self._folders("base")
        if version is not None and version not in (*versions, *bases):
            raise ValueError(f"version {version} is not there, or no longer")
        versions, bases = ([v for v in x if version is None or v <= version] for x in (versions, bases))
        base = max(bases, default=0)
        logged = T.StructType([*self.schema.fields, T.StructField("__op", T.StringType())])
        read = lambda folder, schema: self.spark.read.schema(schema).parquet(f"{self.path}/{folder}")
        rows = [read(f"version={v}", logged).withColumn("__version", F.lit(v)) for v in versions if v > base]
        if base:
            rows.append(read(f"base={base}", self.schema).withColumns({"__op": F.lit("upsert"), "__version": F.lit(base)}))
        if not rows:
            return self.spark.createDataFrame([], self.schema)
        all_rows = rows[0]
        for more in rows[1:]:
            all_rows = all_rows.unionByName(more)
        entry = F.struct("__version", "__op", F.struct(*(F.col(f"`{n}`") for n in self.schema.names)).alias("row"))
        newest = all_rows.groupBy(F.col(f"`{self.key}`").alias("__key")).agg(F.max(entry).alias("newest"))
        return newest.where("newest.__op = 'upsert'").select("newest.row.*")

    def changes(self, since: int, until: int | None = None) -> DataFrame:
        """(key, before, after) of the keys whose rows differ between two versions; null where there is none."""
        whole = lambda x, name: x.select(F.col(f"`{self.key}`").alias("key"), F.struct(*(F.col(f"`{n}`") for n in self.schema.names)).alias(name))
        a, b = whole(self.snapshot(since), "before"), whole(self.snapshot(until), "after").withColumnRenamed("key", "other")
        x = a.join(b, F.col("key").eqNullSafe(F.col("other")), "full").where(~F.col("before").eqNullSafe(F.col("after")))
        return x.select(F.coalesce("key", "other").alias("key"), "before", "after")

    def compact(self) -> int:
        """Write the last snapshot as a base, from which later ones start."""
        version = max(self.versions(), default=0)
        self.snapshot().write.parquet(f"{self.path}/base={version}")
        return version

    def vacuum(self) -> None:
        """Delete the versions that a base holds."""
        base = max(self._folders("base"), default=0)
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for kind, upto in (("version", base), ("base", base - 1)):
            for v in self._folders(kind):
                if v <= upto:
                    fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}={v}"), True)

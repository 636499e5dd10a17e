"""Scratch tables in a folder that all machines share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; where that is unset, the warehouse, unless that is a folder of one machine
    and the session has several."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir")
        if not spark.sparkContext.master.startswith("local") and (root.startswith("file:") or "://" not in root):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share: the warehouse is a local one")
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, deleted when the driver ends."""
    path = f"{scratch_root(spark)}/veldspar/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended already; the folder is scratch space
        pass


def materialise(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder, in a folder for each value of `by`, and read it back: cuts
    lineage, and survives the loss of any executor because no copy lives on one."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__[_PATH] = path
    return out


#: Where a frame that was materialised remembers its folder.
_PATH = "_veldspar_scratch"


def discard(*frames: DataFrame | None) -> None:
    """Delete the folders of materialised frames that nothing will read any more; other frames are passed over. For rounds that write a table
    each, so that the shared folder holds one of them and not all."""
    for df in frames:
        if df is not None and _PATH in df.__dict__:
            _delete(df.sparkSession, df.__dict__.pop(_PATH))

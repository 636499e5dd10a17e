"""Streams: event windows with late data, sessions, duplicates, and enrichment of arriving documents.

The batch expressions are used unchanged; only reading, watermarks and sinks differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldspar.functions import text as X
from veldspar.operators.scratch import scratch_path


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, or folder of Parquet files, as a stream. The schema is that of what is there now."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    one = spark.readStream.schema(schema)
    found = one.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") and _is_file(spark, path) else one.parquet(path)
    # Watermarks want timestamps with a zone.
    return found.withColumns({c: F.col(c).cast("timestamp") for c, kind in found.dtypes if kind == "timestamp_ntz"})


def _is_file(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile()


def windowed(events: DataFrame, length: str, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type and window. Events later than the watermark are dropped."""
    w = F.window("ts", length)
    x = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return x.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessionized(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    x = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return x.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def enriched(docs: DataFrame) -> DataFrame:
    """Arriving documents with counts, category and language: stateless, so a batch gives the same rows."""
    clean = X.clean_text(F.col("text"))
    return docs.select("doc_id", F.size(X.words(clean)).alias("words"), X.category(clean)["name"].alias("category"), X.is_turkish(clean).alias("language"))


def run_once(stream: DataFrame, mode: str = "append", marks: str | None = None) -> DataFrame:
    """Run a stream over what is there now and return its rows, which each batch writes to a table in the shared folder
    by its number, so that a batch that is run again replaces what it wrote. With the marks of an earlier run it goes on where that
    ended, and returns the rows that are new."""
    spark = stream.sparkSession
    path, marks = scratch_path(spark, "stream"), marks or scratch_path(spark, "stream-marks")

    def write(rows: DataFrame, n: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={n}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", marks).trigger(availableNow=True).start()
    q.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    spark.createDataFrame([], stream.schema).write.parquet(f"{path}/batch=-1")
    made = spark.read.schema(schema).parquet(path)
    if mode == "complete":  # the last batch has all rows
        made = made.where(F.col("batch") == made.select(F.max("batch")).first()[0])
    return made.drop("batch")


def run_windows(spark: SparkSession, path: str, length: str) -> DataFrame:
    return run_once(windowed(read_stream(spark, path), length), "complete")

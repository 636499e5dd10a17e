"""Joins of two streams on a key and an interval of event times, with watermarks on both sides.

A row of the first stream meets those rows of the second that come within `within` after it. Both watermarks bound the state: a row is
kept until no row that may still come can meet it, and with how="left" it then comes out alone, once. Rows later than their watermark
are dropped. Batches give the same rows, but for those of the left outer join whose time is not over yet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def followed_by(first: DataFrame, second: DataFrame, key: str, time: str, within: str, late: str = "10 minutes", how: str = "inner") -> DataFrame:
    """Rows of first with the rows of second (its columns named next_*) of the same key, from its time on to `within` after it."""
    a = first.withWatermark(time, late)
    b = second.select(*(F.col(c).alias(f"next_{c}") for c in second.columns)).withWatermark(f"next_{time}", late)
    after = (F.col(f"next_{time}") >= F.col(time)) & (F.col(f"next_{time}") <= F.col(time) + F.expr(f"INTERVAL {within}"))
    return a.join(b, (F.col(key) == F.col(f"next_{key}")) & after, how)

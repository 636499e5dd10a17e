"""A cache as a stream operator: entries by key with a lifetime, counting hits and misses.

The state of a key is one entry: when it was made, when it was last asked for, and how often it hit. A request finds the entry if it
was made less than the lifetime before, and is a miss otherwise, which makes a new one. Everything goes by event time: a timer at the end of an entry's life removes the
state once the watermark has passed it, and tells of the entry, so state never outgrows the keys that are alive. Requests of a
batch are taken in order of time, with a batch's or several, so one batch or many give the same answers; requests later than the
watermark are dropped, as in any stream.

Needs a state store with column families: `run` sets Spark's RocksDB store for the stream and puts the setting back.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veldspar.streaming.events import run_once

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SETTING = "spark.sql.streaming.stateStore.providerClass"
#: kind is hit or miss for a request, expired for an entry's end; uses: the hits of the entry so far.
RESULT = "key string, kind string, at timestamp, made timestamp, uses long"


class Entries(StatefulProcessor):
    """The entry of one key."""

    def __init__(self, seconds: int):
        self.life = pd.Timedelta(seconds=seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "made timestamp, uses long")

    def _timer(self, made: pd.Timestamp) -> int:
        """When an entry ends: in whole milliseconds, the first that is not within its life."""
        return -(-int((made + self.life).value) // 1_000_000)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        asked = pd.concat(list(rows)).sort_values("ts", kind="stable")["ts"]
        held = self.entry.get() if self.entry.exists() else None
        made, uses = (pd.Timestamp(held[0]), int(held[1])) if held else (None, 0)
        before, out = made, []
        for ts in asked:
            if made is not None and ts < made + self.life:
                uses += 1
                out.append((key[0], "hit", ts, made, uses))
                continue
            if made is not None:
                out.append((key[0], "expired", made + self.life, made, uses))
            made, uses = ts, 0
            out.append((key[0], "miss", ts, made, 0))
        if made is not before:
            if before is not None:
                self.handle.deleteTimer(self._timer(before))
            self.handle.registerTimer(self._timer(made))
        self.entry.update((made.to_pydatetime(), uses))
        yield pd.DataFrame(out, columns=["key", "kind", "at", "made", "uses"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if not self.entry.exists():
            return
        held = self.entry.get()
        made = pd.Timestamp(held[0])
        self.entry.clear()
        yield pd.DataFrame([(key[0], "expired", made + self.life, made, int(held[1]))], columns=["key", "kind", "at", "made", "uses"])

    def close(self) -> None:
        pass


def cached(requests: DataFrame, seconds: int, late: str = "10 minutes") -> DataFrame:
    """The answers of the cache to a stream of requests(key, ts)."""
    asked = requests.select(F.col("key").cast("string").alias("key"), F.col("ts")).withWatermark("ts", late)
    return asked.groupBy("key").transformWithStateInPandas(Entries(seconds), RESULT, "Append", "EventTime")


def run(requests: DataFrame, seconds: int, late: str = "10 minutes", marks: str | None = None) -> DataFrame:
    """All answers to the requests that are there now."""
    conf, before = requests.sparkSession.conf, requests.sparkSession.conf.get(SETTING)
    conf.set(SETTING, ROCKS)
    try:
        return run_once(cached(requests, seconds, late), "append", marks)
    finally:
        conf.set(SETTING, before)


def stats(answers: DataFrame) -> DataFrame:
    """One row: entries made, hits, misses, and the share of hits."""
    x = answers.agg(F.count_if(F.col("kind") == "hit").alias("hits"), F.count_if(F.col("kind") == "miss").alias("misses"))
    return x.select(F.col("misses").alias("entries"), "hits", "misses", F.coalesce(F.try_divide(F.col("hits"), F.col("hits") + F.col("misses")), F.lit(0.0)).alias("hit_rate"))

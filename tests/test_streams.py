"""Streams that run in several batches: a cache's state and timers, and joins with late rows."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from veldspar.operators.scratch import scratch_path
from veldspar.plans import catalogue
from veldspar.streaming import cache, joins
from veldspar.streaming.events import run_once

START = datetime.datetime(2024, 1, 1)
at = lambda minutes: START + datetime.timedelta(minutes=minutes)


def plain_cache(requests, life):
    """(key, kind, at) of hits and misses."""
    made, out = {}, []
    for key, ts in sorted(requests, key=lambda x: x[1]):
        hit = key in made and ts < made[key] + life
        if not hit:
            made[key] = ts
        out.append((key, "hit" if hit else "miss", ts))
    return sorted(out)


def test_cache_goes_on_from_its_marks(spark):
    r = random.Random(4)
    requests = [(r.choice("abcd"), at(m + r.random())) for m in range(0, 600, 3)]
    folder, marks, got = scratch_path(spark, "requests"), scratch_path(spark, "marks"), []
    for first in range(0, len(requests), 50):
        spark.createDataFrame(requests[first : first + 50], "key string, ts timestamp").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("key string, ts timestamp").parquet(folder)
        got += [(x.key, x.kind, x.at, x.made, x.uses) for x in cache.run(stream, 3600, "1 minute", marks).collect()]
    life = datetime.timedelta(hours=1)
    assert sorted(x[:3] for x in got if x[1] != "expired") == plain_cache(requests, life)
    # Every entry ends once: when the next one of its key is made, or by its timer when the watermark has passed its end.
    last = max(ts for _, ts in requests) - datetime.timedelta(minutes=1)
    made = {(k, ts) for k, kind, ts, _, _ in got if kind == "miss"}
    ended = [(k, m) for k, kind, _, m, _ in got if kind == "expired"]
    assert len(ended) == len(set(ended)) and set(ended) <= made
    assert set(ended) >= {(k, m) for k, m in made if m + life < last - datetime.timedelta(minutes=5)}
    uses = {(k, m): n for k, kind, _, m, n in got if kind == "expired"}
    assert all(n == sum(1 for k2, kind, _, m2, _ in got if (k2, m2, kind) == (k, m, "hit")) for (k, m), n in uses.items())


def test_timers_free_state_without_requests(spark):
    folder, marks = scratch_path(spark, "requests"), scratch_path(spark, "marks")
    write = lambda rows: spark.createDataFrame(rows, "key string, ts timestamp").coalesce(1).write.mode("append").parquet(folder)
    run = lambda: sorted((x.key, x.kind, x.at) for x in cache.run(spark.readStream.schema("key string, ts timestamp").parquet(folder), 600, "1 minute", marks).collect())
    write([("a", at(0)), ("a", at(5)), ("b", at(1))])
    assert run() == [("a", "hit", at(5)), ("a", "miss", at(0)), ("b", "miss", at(1))]
    write([("c", at(100))])
    assert run() == [("a", "expired", at(10)), ("b", "expired", at(11)), ("c", "miss", at(100))]
    write([("a", at(2)), ("a", at(120))])  # the first is later than the watermark
    assert run() == [("a", "miss", at(120)), ("c", "expired", at(110))]
    assert cache.stats(spark.createDataFrame([("a", "hit"), ("a", "miss"), ("b", "expired")], "key string, kind string")).first().asDict() == {"entries": 1, "hits": 1, "misses": 1, "hit_rate": 0.5}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_of_streams_in_batches(spark, how):
    clicks, buys, marks = (scratch_path(spark, n) for n in ("clicks", "buys", "marks"))
    schema = "user int, n int, ts timestamp"
    put = lambda path, rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    put(clicks, [(1, 1, at(0)), (1, 2, at(30)), (2, 3, at(10)), (3, 4, at(20))])
    put(buys, [(1, 11, at(40)), (2, 12, at(90)), (2, 13, at(5))])
    read = lambda path: spark.readStream.schema(schema).parquet(path)
    run = lambda: sorted(((x.n, x.next_n) for x in run_once(joins.followed_by(read(clicks), read(buys), "user", "ts", "1 HOUR", "5 minutes", how), "append", marks).collect()), key=str)
    assert [x for x in run() if x[1]] == [(1, 11), (2, 11)]
    # A purchase within the hour that comes in a later batch still meets its click; rows later than the watermark meet nothing.
    put(clicks, [(4, 5, at(300)), (3, 6, at(1))])
    put(buys, [(3, 14, at(75)), (4, 15, at(310)), (1, 16, at(2))])
    found = run()
    assert [x for x in found if x[1]] == [(4, 14), (5, 15)]
    put(clicks, [(9, 7, at(900))])
    put(buys, [(9, 17, at(900))])
    rest = found + run()
    assert (7, 17) in rest and (((3, None) in rest) == (how == "left")) and (1, None) not in rest and (4, None) not in rest


def test_stream_and_batch_of_events(spark, sf):
    queries = catalogue.queries()
    events = spark.read.parquet(f"{sf}/events.parquet")
    asked = [(str(r.user_id), r.ts) for r in events.collect()]
    got = sorted((x.key, x.kind, x.at) for x in queries["cache_stream"](spark, sf).collect())
    assert got == plain_cache(asked, datetime.timedelta(hours=6))
    assert queries["stream_join_outer"](spark, sf).where(F.col("next_event_id").isNotNull()).count() == queries["stream_join"](spark, sf).count()

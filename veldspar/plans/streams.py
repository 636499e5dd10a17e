"""Queries of streams that are run to the end of what is there: keyed state and joins of streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldspar.plans.registry import query
from veldspar.streaming import cache, joins
from veldspar.streaming.events import read_stream, run_once

LIFE = 6 * 3600


@query("""WITH RECURSIVE m AS (SELECT user_id, min(ts) AS made FROM events GROUP BY user_id
  UNION ALL SELECT m.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = m.user_id AND e.ts >= m.made + INTERVAL 6 HOUR) FROM m WHERE m.made IS NOT NULL),
x AS (SELECT e.user_id, e.ts, m.made FROM events e ASOF JOIN (SELECT * FROM m WHERE made IS NOT NULL) m ON e.user_id = m.user_id AND e.ts >= m.made)
SELECT user_id::VARCHAR AS key, CASE WHEN ts = made THEN 'miss' ELSE 'hit' END AS kind, ts AS at, made, row_number() OVER (PARTITION BY user_id, made ORDER BY ts) - 1 AS uses FROM x""")
def cache_stream(spark, sf_dir):
    """Hits and misses of a cache whose entries live for six hours, as keyed state of a stream."""
    answers = cache.run(read_stream(spark, f"{sf_dir}/events.parquet").select(F.col("user_id").alias("key"), "ts"), LIFE)
    plain = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return answers.where("kind <> 'expired'").select("key", "kind", plain("at"), plain("made"), "uses")


def _clicks_and_purchases(spark, sf_dir):
    rows = lambda kind: read_stream(spark, f"{sf_dir}/events.parquet").where(F.col("event_type") == kind).select("user_id", "event_id", "ts")
    return rows("click"), rows("purchase")


@query("""SELECT c.user_id, c.event_id, p.event_id AS next_event_id FROM events c JOIN events p ON c.user_id = p.user_id AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 1 HOUR
WHERE c.event_type = 'click' AND p.event_type = 'purchase'""")
def stream_join(spark, sf_dir):
    """Purchases within an hour of a click of the same user, two streams joined."""
    return run_once(joins.followed_by(*_clicks_and_purchases(spark, sf_dir), "user_id", "ts", "1 HOUR")).select("user_id", "event_id", "next_event_id")


@query("""WITH c AS (SELECT * FROM events WHERE event_type = 'click'), p AS (SELECT * FROM events WHERE event_type = 'purchase'),
w AS (SELECT least((SELECT max(ts) FROM c), (SELECT max(ts) FROM p)) - INTERVAL 10 MINUTE AS mark)
SELECT c.user_id, c.event_id, p.event_id AS next_event_id FROM c LEFT JOIN p ON c.user_id = p.user_id AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 1 HOUR, w
WHERE p.event_id IS NOT NULL OR c.ts + INTERVAL 1 HOUR < mark""")
def stream_join_outer(spark, sf_dir):
    """The same with clicks that nothing follows, once the watermark says that nothing can."""
    return run_once(joins.followed_by(*_clicks_and_purchases(spark, sf_dir), "user_id", "ts", "1 HOUR", how="left")).select("user_id", "event_id", "next_event_id")

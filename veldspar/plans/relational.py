"""Relational queries: joins, aggregates, windows, set operations, time windows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veldspar.operators import relational as R
from veldspar.operators.scratch import materialise
from veldspar.plans.registry import QUERIES, SQL, query, table

# Queries whose text both engines read alike.
_SHARED = {
    "pricing_summary": """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc,
  round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "shipping_priority": """
SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1995-03-15 00:00:00' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
    "discount_revenue": "SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue, count(*) AS n FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    "returned_items": """
SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, c_acctbal, n_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
WHERE l_returnflag = 'R' GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "large_orders": """
SELECT c_custkey, o_orderkey, o_totalprice, sum(l_quantity) AS quantity FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 150) GROUP BY c_custkey, o_orderkey, o_totalprice""",
    "customers_without_orders": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "customers_with_urgent_orders": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    "parts_above_average": "SELECT p_partkey, p_retailprice FROM part p WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)",
    "order_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "order_cube": "SELECT c_mktsegment, o_orderstatus, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY CUBE (c_mktsegment, o_orderstatus)",
    "line_grouping_sets": "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ())",
    "nations_intersect": "SELECT s_nationkey AS nation FROM supplier INTERSECT SELECT c_nationkey FROM customer",
    "nations_except": "SELECT n_nationkey AS nation FROM nation EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000",
    "nations_union": "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region",
    "nations_union_all": "SELECT s_nationkey AS nation FROM supplier WHERE s_acctbal > 5000 UNION ALL SELECT c_nationkey FROM customer WHERE c_acctbal > 9000",
    "customer_windows": """
SELECT o_custkey, o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS rk, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS dr,
  lag(o_totalprice) OVER w AS previous, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving, first_value(o_orderkey) OVER w AS first_key FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "full_outer_nations": "SELECT a.k AS a, b.k AS b FROM (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 15) a FULL OUTER JOIN (SELECT n_nationkey AS k FROM nation WHERE n_nationkey > 10) b ON a.k = b.k",
    "first_per_key": "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) t WHERE n = 1",
    "success_rate": "SELECT event_type, count(*) AS n, sum(CASE WHEN value > 0 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS rate FROM events GROUP BY event_type",
}


def _add(name: str, text: str) -> None:
    def run(spark, sf_dir):
        R.tables(spark, sf_dir)
        return spark.sql(text)

    run.__name__ = name
    QUERIES[name], SQL[name] = run, text


for _name, _text in _SHARED.items():
    _add(_name, _text)


#: Lines of a task, about.
LINES = 500_000


@query("""
SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, count(DISTINCT o_orderkey) AS n_orders FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""")
def regional_volume(spark, sf_dir):
    """Revenue and orders of each nation's suppliers. Lines are dealt out by order to as many tasks as they ask for and added up by order and
    nation there, so that each order counts once and no task holds more than its share of them."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // LINES))
    orders = orders.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey").select("o_orderkey")
    sold = lines.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    sold = sold.select(F.col("l_orderkey").alias("o_orderkey"), "s_nationkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("part"))
    both = sold.repartition(tasks, "o_orderkey").join(orders.repartition(tasks, "o_orderkey").hint("merge"), "o_orderkey")
    each = both.groupBy("o_orderkey", "s_nationkey").agg(F.sum("part").alias("part"))
    total = each.groupBy("s_nationkey").agg(F.sum("part").alias("revenue"), F.count(F.lit(1)).alias("n_orders"))
    named = total.join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return named.groupBy("r_name", "n_name").agg(F.round(F.sum("revenue"), 4).alias("revenue"), F.sum("n_orders").alias("n_orders"))


@query("SELECT l_linestatus, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS a, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS n, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS r FROM lineitem GROUP BY l_linestatus")
def flag_pivot(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").groupBy("l_linestatus").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity"))
    return x.withColumnsRenamed({"A": "a", "N": "n", "R": "r"})


@query("SELECT bucket, count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high FROM (SELECT o_totalprice, CAST(ntile(10) OVER (ORDER BY o_totalprice, o_orderkey) AS BIGINT) AS bucket FROM orders) t GROUP BY bucket")
def price_buckets(spark, sf_dir):
    """Ten buckets of equal numbers by price: ranks come from ranges of prices, so no task sees all rows; the first n % 10 buckets have one row more."""
    ranked = R.ordinal(table(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey"), ["o_totalprice", "o_orderkey"], "nth")
    n = ranked.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    size, more = F.floor(n / 10), n % 10
    at, upto = F.col("nth") - 1, more * (size + 1)
    bucket = F.when(at < upto, F.floor(at / (size + 1))).otherwise(more + F.floor((at - upto) / F.greatest(size, F.lit(1)))) + 1
    return ranked.groupBy(bucket.cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))


@query("SELECT p_partkey, k AS measure, v AS value FROM (SELECT p_partkey, unnest(['size', 'price']) AS k, unnest([p_size::DOUBLE, p_retailprice]) AS v FROM part)")
def part_unpivot(spark, sf_dir):
    x = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return x.unpivot("p_partkey", ["size", "price"], "measure", "value")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def event_tumbling(spark, sf_dir):
    w = F.window("ts", "1 hour")
    return table(spark, sf_dir, "events").groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("""SELECT s AS start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY s""")
def event_sliding(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 3600 THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n FROM s GROUP BY user_id, session""")
def event_sessions(spark, sf_dir):
    return R.sessions(table(spark, sf_dir, "events"), "user_id", "ts", 3600)


@query("""SELECT e.event_id, e.user_id, p.value AS asof_value FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY ALL) p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def event_asof(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    clicks = e.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return R.asof_join(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), clicks, "user_id", "ts", "ts", ["value"]).select("event_id", "user_id", "asof_value")


@query("SELECT o_orderkey, band FROM orders JOIN (SELECT s_suppkey AS band, s_acctbal * 20 AS low, s_acctbal * 20 + 3000 AS high FROM supplier WHERE s_acctbal > 0) b ON o_totalprice >= low AND o_totalprice < high")
def price_range_join(spark, sf_dir):
    bands = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("band"), (F.col("s_acctbal") * 20).alias("low"), (F.col("s_acctbal") * 20 + 3000).alias("high"))
    return R.range_join(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), bands, "o_totalprice", "low", "high", 3000.0).select("o_orderkey", "band")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_orderdate AS low, max(l_shipdate) AS high FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT a.o_custkey, a.o_orderkey AS a, b.o_orderkey AS b FROM r a JOIN r b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.low < b.high AND b.low < a.high WHERE a.low < a.high AND b.low < b.high""")
def order_overlaps(spark, sf_dir):
    """Pairs of orders of a customer that were open at the same time, from the order to its last shipment."""
    last = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("high"))
    open_ = materialise(table(spark, sf_dir, "orders").join(last, "o_orderkey").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("low"), "high"), "open-orders")
    other = open_.select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("b"), F.col("low").alias("b_low"), F.col("high").alias("b_high"))
    x = R.overlap_join(open_, other, "low", "high", "b_low", "b_high", 60.0 * 86400, [("o_custkey", "cust")])
    return x.where("o_orderkey < b").select("o_custkey", F.col("o_orderkey").alias("a"), "b")


@query("SELECT c_mktsegment, c_custkey, rank FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey)::INT AS rank FROM customer) WHERE rank <= 3")
def top_customers(spark, sf_dir):
    return R.top_per_group(table(spark, sf_dir, "customer"), "c_mktsegment", [F.desc("c_acctbal"), F.asc("c_custkey")], 3).select("c_mktsegment", "c_custkey", "rank")


@query("SELECT json_extract_string(props, '$.' || k) AS value, k AS name, count(*) AS n FROM (SELECT props, unnest(json_keys(props)) AS k FROM events) GROUP BY ALL")
def event_properties(spark, sf_dir):
    m = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").select(F.explode(m).alias("name", "value")).groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))


@query()
def approximate_counts(spark, sf_dir):
    """Sketch-based distinct counts and quantiles (approximate, so without SQL)."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.percentile_approx("l_extendedprice", 0.5).alias("median"))


@query("SELECT source AS category, count(*) AS files, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY ROLLUP (source)")
def scan_stats_rollup(spark, sf_dir):
    from veldspar.sources.files import scan_stats

    return scan_stats(table(spark, sf_dir, "documents").select(F.col("source").alias("category"), F.col("n_chars").alias("size")))


@query("SELECT conv_id, count(*) AS turns, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS dialogue FROM conversations GROUP BY conv_id")
def conversation_text(spark, sf_dir):
    ordered = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), F.coalesce("text", F.lit(""))).alias("line"))))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.array_join(F.transform(ordered, lambda r: r["line"]), "\n").alias("dialogue"))


@query("SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS upto FROM conversations")
def conversation_turns(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lag("role").over(w).alias("previous"), F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def event_stream(spark, sf_dir):
    """Daily windows over the events read as a stream, run to its end."""
    from veldspar.streaming.events import run_windows

    return run_windows(spark, f"{sf_dir}/events.parquet", "1 day").withColumn("total", F.round("total", 6)).withColumn("start", F.col("start").cast("timestamp_ntz"))

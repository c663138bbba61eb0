"""Queries over streams' batch twins and the plain relational operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..streaming import events as ev


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _ntz(df):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


def tumbling(spark, d):
    return _ntz(ev.tumbling(_t(spark, d, "events")))


def sliding(spark, d):
    return _ntz(ev.sliding(_t(spark, d, "events")))


def session(spark, d):
    return _ntz(ev.sessions(_t(spark, d, "events")))


def dedup_watermark(spark, d):
    return ev.distinct_events(_t(spark, d, "events")).select("event_id", "user_id", "event_type")


def stream_enrich(spark, d):
    return ev.enriched(_t(spark, d, "events"), _t(spark, d, "customer"))


def rank_parts(spark, d):
    w = Window.partitionBy("p_brand").orderBy(F.col("p_retailprice").desc(), "p_partkey")
    return _t(spark, d, "part").select("p_brand", "p_partkey", F.row_number().over(w).alias("nth"), F.lead("p_partkey").over(w).alias("next"), F.ntile(4).over(w).alias("quarter")).where("nth <= 10")


def running_total(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cents = F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long")
    return _t(spark, d, "orders").select("o_custkey", "o_orderkey", F.sum(cents).over(w).alias("cents"))


def set_operations(spark, d):
    """Nations with suppliers and customers, with one of them only, and how often."""
    s = _t(spark, d, "supplier").select(F.col("s_nationkey").alias("n"))
    c = _t(spark, d, "customer").select(F.col("c_nationkey").alias("n"))
    tagged = s.intersect(c).withColumn("kind", F.lit("both")).unionByName(c.exceptAll(s).withColumn("kind", F.lit("more customers"))).unionByName(s.subtract(c).withColumn("kind", F.lit("suppliers only")))
    return tagged.groupBy("n", "kind").agg(F.count("*").alias("times"))


def full_outer(spark, d):
    s = _t(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    c = _t(spark, d, "customer").where("c_nationkey < 20").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    return s.join(c, F.col("s_nationkey") == F.col("c_nationkey"), "full").select(F.coalesce("s_nationkey", "c_nationkey").alias("nation"), "suppliers", "customers")


def asof_events(spark, d):
    """Each purchase with the same user's last click before it: a sorted fold, no range join."""
    e = _t(spark, d, "events").where("event_type IN ('click', 'purchase')")
    w = Window.partitionBy("user_id").orderBy("ts", F.col("event_type") == "purchase", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("click_id", last).where("event_type = 'purchase'").select("event_id", "user_id", "click_id")


def star_revenue(spark, d):
    """Revenue by region and year over the whole star."""
    cents = F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100 + 0.5).cast("long")
    o = _t(spark, d, "lineitem").join(_t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    n = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return o.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name", F.year("o_orderdate").cast("long").alias("year")).agg(F.sum(cents).alias("cents"), F.count("*").alias("n_lines"))


def cube_flags(spark, d):
    return _t(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


QUERIES = {
    "tumbling": (tumbling, "SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, event_type, count(*) AS n, CAST(sum(CAST(floor(value * 100e0 + 0.5e0) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2, 3"),
    "sliding": (
        sliding,
        "WITH s AS (SELECT time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 12 HOUR AS w FROM events, (VALUES (0), (1)) v(k)) SELECT w AS window_start, w + INTERVAL 1 DAY AS window_end, count(*) AS n FROM s GROUP BY 1, 2",
    ),
    "session": (
        session,
        "WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTE AS window_end, user_id, count(*) AS n FROM g GROUP BY user_id, s",
    ),
    "dedup_watermark": (dedup_watermark, "SELECT DISTINCT ON (event_id) event_id, user_id, event_type FROM events"),
    "stream_enrich": (stream_enrich, "SELECT event_id, user_id, event_type, c_mktsegment AS segment FROM events LEFT JOIN customer ON c_custkey = user_id"),
    "rank_parts": (
        rank_parts,
        "WITH r AS (SELECT p_brand, p_partkey, CAST(row_number() OVER w AS INTEGER) AS nth, lead(p_partkey) OVER w AS next, CAST(ntile(4) OVER w AS INTEGER) AS quarter FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)) SELECT * FROM r WHERE nth <= 10",
    ),
    "running_total": (running_total, "SELECT o_custkey, o_orderkey, CAST(sum(CAST(floor(o_totalprice * 100e0 + 0.5e0) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cents FROM orders"),
    "set_operations": (
        set_operations,
        "WITH s AS (SELECT s_nationkey AS n FROM supplier), c AS (SELECT c_nationkey AS n FROM customer), t AS (SELECT n, 'both' AS kind FROM (SELECT n FROM s INTERSECT SELECT n FROM c) UNION ALL SELECT n, 'more customers' FROM (SELECT n FROM c EXCEPT ALL SELECT n FROM s) UNION ALL SELECT n, 'suppliers only' FROM (SELECT n FROM s EXCEPT SELECT n FROM c)) SELECT n, kind, count(*) AS times FROM t GROUP BY 1, 2",
    ),
    "full_outer": (
        full_outer,
        "WITH s AS (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1), c AS (SELECT c_nationkey, count(*) AS customers FROM customer WHERE c_nationkey < 20 GROUP BY 1) SELECT coalesce(s_nationkey, c_nationkey) AS nation, suppliers, customers FROM s FULL JOIN c ON s_nationkey = c_nationkey",
    ),
    "asof_events": (
        asof_events,
        "WITH e AS (SELECT *, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_type = 'purchase', event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS click_id FROM events WHERE event_type IN ('click', 'purchase')) SELECT event_id, user_id, click_id FROM e WHERE event_type = 'purchase'",
    ),
    "star_revenue": (
        star_revenue,
        "SELECT r_name, year(o_orderdate) AS year, CAST(sum(CAST(floor(l_extendedprice * (1 - l_discount) * 100e0 + 0.5e0) AS BIGINT)) AS BIGINT) AS cents, count(*) AS n_lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
    ),
    "cube_flags": (cube_flags, "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"),
}

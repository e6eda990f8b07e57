"""Queries over telemetry: rates, estimates, idleness, limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillframe.operators import limits, telemetry
from quillframe.plans.registry import query, table


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress samples: per user the running numbers of events and of purchases."""
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0)
    events = table(spark, sf_dir, "events")
    return events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.count("*").over(w).alias("segments"), F.count_if(F.col("event_type") == "purchase").over(w).alias("stories"))


_SAMPLES = """
WITH s AS (SELECT user_id, epoch_us(ts) // 1000000 AS sec, count(*) OVER w AS segments, count(*) FILTER (WHERE event_type = 'purchase') OVER w AS stories FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
n AS (SELECT *, max(sec) OVER (PARTITION BY user_id) - 86400 AS since, row_number() OVER (PARTITION BY user_id ORDER BY sec DESC, segments DESC, stories DESC) AS r FROM s),
p AS (SELECT user_id, count(*) AS n_all, count(*) FILTER (WHERE sec >= since) AS n_near FROM n WHERE sec >= since OR r <= 20 GROUP BY 1),
f AS (SELECT n.user_id, arg_max({'sec': sec, 'c': segments, 's': stories}, -r) AS last, arg_max({'sec': sec, 'c': segments, 's': stories}, r) FILTER (WHERE sec >= since) AS near, arg_max({'sec': sec, 'c': segments, 's': stories}, r) FILTER (WHERE r <= 20) AS few FROM n GROUP BY 1),
g AS (SELECT user_id, last, CASE WHEN n_near >= 2 THEN near ELSE few END AS first, n_all FROM f JOIN p USING (user_id))
"""


@query(_SAMPLES + """
SELECT user_id, CASE WHEN n_all >= 2 THEN CAST(last.sec - first.sec AS DOUBLE) END AS window_seconds,
  CASE WHEN n_all >= 2 AND last.sec - first.sec >= 30 AND last.c - first.c >= 5 THEN round((last.c - first.c) * 3600.0 / (last.sec - first.sec), 6) END AS segments_per_hour,
  CASE WHEN n_all >= 2 AND last.sec - first.sec >= 30 AND last.s - first.s >= 2 THEN round((last.s - first.s) * 3600.0 / (last.sec - first.sec), 6) END AS stories_per_hour FROM g""")
def recent_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of each user's last day, or of the last samples."""
    samples = _samples(spark, sf_dir).withColumn("at", F.floor(F.col("us") / 1000000))
    samples = samples.withColumn("now", F.max("at").over(W.partitionBy("user_id")))
    rates = telemetry.recent_rates(samples, "user_id", "at", "segments", "stories", F.col("now"), window=86400)
    return rates.select("user_id", "window_seconds", F.round("segments_per_hour", 6).alias("segments_per_hour"), F.round("stories_per_hour", 6).alias("stories_per_hour"))


@query("""
SELECT o_custkey, round(CASE WHEN count(*) FILTER (WHERE o_orderstatus <> 'O') = 0 THEN 1.0 ELSE greatest(0.05, least(1.0, 1 - (1 - count(*) FILTER (WHERE o_orderstatus = 'F') / count(*) FILTER (WHERE o_orderstatus <> 'O')) * least(1.0, count(*) FILTER (WHERE o_orderstatus <> 'O') / 500))) END, 9) AS ratio
FROM orders GROUP BY o_custkey""")
def yield_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of queued work that will count, per customer."""
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_orderstatus") != "O").alias("processed"))
    return per.select("o_custkey", F.round(telemetry.yield_ratio(F.col("done"), F.col("processed")), 9).alias("ratio"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows of a batch per customer: status, total and crawled segments."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    counts = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("total"))
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "crawling").when(F.col("o_orderkey") % 5 == 0, "skipped").otherwise("queued")
    rows = orders.join(counts, "o_orderkey", "left").select("o_custkey", status.alias("status"), "total", "o_orderkey")
    crawled = F.when(F.col("status") == "completed", F.col("total")).when(F.col("status") == "crawling", F.floor(F.col("total") / 2)).otherwise(0)
    return rows.withColumn("crawled", F.coalesce(crawled, F.lit(0)))


@query("""
WITH r AS (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'crawling' ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'skipped' ELSE 'queued' END END AS status, (SELECT nullif(count(*), 0) FROM lineitem WHERE l_orderkey = o_orderkey) AS total FROM orders),
c AS (SELECT *, coalesce(CASE status WHEN 'completed' THEN total WHEN 'crawling' THEN total // 2 ELSE 0 END, 0) AS crawled, status IN ('completed', 'skipped', 'failed') AS done FROM r),
w AS (SELECT o_custkey, count(*) FILTER (WHERE done) AS processed, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) AS stories, sum(crawled) AS crawled,
  coalesce(avg(crawled) FILTER (WHERE status = 'completed' AND crawled > 0), avg(total) FILTER (WHERE total > 0), 0) AS average,
  coalesce(sum(greatest(0, total - crawled)) FILTER (WHERE NOT done AND total > 0 AND status = 'crawling'), 0) AS active, coalesce(sum(greatest(0, total - crawled)) FILTER (WHERE NOT done AND total > 0 AND status <> 'crawling'), 0) AS queued,
  count(*) FILTER (WHERE NOT done AND coalesce(total, 0) = 0) AS unknown FROM c GROUP BY 1),
y AS (SELECT *, CASE WHEN processed > 0 THEN greatest(0.05, least(1.0, 1 - (1 - completed / processed) * least(1.0, processed / 500))) ELSE 1.0 END AS ratio FROM w)
SELECT o_custkey, CAST(stories - processed AS BIGINT) AS remaining_stories, CAST(active + round_even(queued * ratio, 0) + round_even(unknown * average * ratio, 0) AS BIGINT) AS remaining_segments,
  CASE WHEN stories = processed THEN 'complete' WHEN crawled > 0 THEN 'all_time_chapters' WHEN processed > 0 THEN 'all_time_stories' ELSE 'insufficient_data' END AS source FROM y""")
def completion_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains per customer, and what the estimate rests on, after a run of an hour."""
    work = telemetry.workload(_rows(spark, sf_dir), "o_custkey", "status", "total", "crawled")
    none = F.lit(None).cast("double")
    return telemetry.estimated(work, none, none, F.col("crawled"), F.lit(3600)).select("o_custkey", "remaining_stories", "remaining_segments", "source")


@query("""
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS spell FROM e)
SELECT user_id, CAST(spell AS BIGINT) AS spell, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY 1, 2""")
def idle_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spells of each user's activity."""
    return telemetry.idle_islands(table(spark, sf_dir, "events").select("user_id", "ts"), "user_id", "ts", 6 * 3600)


@query("""
WITH s AS (SELECT *, count(*) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS stretch FROM events),
b AS (SELECT *, count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id, stretch ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id, stretch, count(*) FILTER (WHERE event_type = 'error') AS blocks, min(event_id) FILTER (WHERE k >= 3) AS opens_at FROM b GROUP BY 1, 2""")
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors between purchases, and where the third one opens the breaker."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return telemetry.breaker(events, "user_id", "event_id", F.col("event_type") == "error", F.col("event_type") == "purchase")


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS "at", row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
s AS (SELECT user_id, event_id, "at", r, true AS accepted, 0 AS retry_after, NULL::DOUBLE AS older, "at" AS newer FROM e WHERE r = 1
  UNION ALL SELECT e.user_id, e.event_id, e."at", e.r, s.older IS NULL OR e."at" - s.older >= 86400, CASE WHEN s.older IS NULL OR e."at" - s.older >= 86400 THEN 0 ELSE greatest(1, CAST(trunc(86400.0 - (e."at" - s.older)) AS INTEGER)) END,
    CASE WHEN s.older IS NULL OR e."at" - s.older >= 86400 THEN s.newer ELSE s.older END, CASE WHEN s.older IS NULL OR e."at" - s.older >= 86400 THEN e."at" ELSE s.newer END FROM s JOIN e ON e.user_id = s.user_id AND e.r = s.r + 1)
SELECT user_id, event_id, "at", accepted, retry_after FROM s""")
def sliding_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events under a limit of two per user and day; rejected ones don't count."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return limits.limited(events, "user_id", "at", limit=2, window=86400.0)


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, event_type = 'error' AS rejected, CASE WHEN event_id % 10 = 0 THEN 30.0::DOUBLE END AS hint, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
s AS (SELECT user_id, 0::BIGINT AS event_id, false AS rejected, NULL::DOUBLE AS hint, 0::BIGINT AS r, 0 AS n, 0 AS ok, 1.0::DOUBLE AS interval, 0.0::DOUBLE AS cooldown FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT e.user_id, e.event_id, e.rejected, e.hint, e.r, CASE WHEN e.rejected THEN s.n + 1 WHEN s.ok + 1 >= 2 THEN 0 ELSE s.n END, CASE WHEN e.rejected OR s.ok + 1 >= 2 THEN 0 ELSE s.ok + 1 END,
    CASE WHEN e.rejected THEN least(5.0, s.interval + 0.5) WHEN s.ok + 1 >= 2 THEN greatest(1.0, s.interval - 0.5) ELSE s.interval END,
    CASE WHEN NOT e.rejected THEN 0.0 WHEN e.hint IS NOT NULL THEN e.hint ELSE least(900.0, 60.0 * 2 ** least(s.n, 10)) END FROM s JOIN e ON e.user_id = s.user_id AND e.r = s.r + 1)
SELECT user_id, event_id, rejected, hint, interval, cooldown FROM s WHERE r > 0""")
def adaptive_pacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval and cooldown after each event, errors being rejections."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("rejected"), F.when(F.col("event_id") % 10 == 0, 30.0).alias("hint"))
    return limits.paced(events, "user_id", "event_id", "rejected", "hint", recover=2)

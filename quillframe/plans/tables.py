"""Queries over tables: scans, pages, conflict policies, changes, queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.functions.values import percent
from quillframe.operators import dedup, queues
from quillframe.operators import tables as changes
from quillframe.operators.telemetry import histogram
from quillframe.plans.registry import query, table

_JOBS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"


@query("SELECT s AS state, (SELECT count(*) FROM orders WHERE o_orderstatus = s) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) v(s)")
def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by state, with 0 for a state that none has."""
    return histogram(table(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O", "P", "X"])


@query("""
SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, count(*) FILTER (WHERE o_orderstatus = 'O') AS open_jobs,
       CAST(floor(count(*) FILTER (WHERE o_orderstatus = 'F') * 100 / count(*)) AS INTEGER) AS percent_done, round(max(o_totalprice), 2) AS largest
FROM orders GROUP BY o_custkey""")
def summary_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional counts per customer in one pass."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count_if(F.col("o_orderstatus") == "O").alias("open_jobs"), F.round(F.max("o_totalprice"), 2).alias("largest"))
    return orders.withColumn("percent_done", percent(F.col("finished"), F.col("n")))


@query("SELECT o_orderkey, o_orderdate, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC LIMIT 50 OFFSET 100")
def newest_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of the newest jobs, with the total."""
    return queues.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), 3, 50, F.desc_nulls_last("o_orderdate"), F.desc("o_orderkey"))


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC LIMIT 100")
def newest_hundred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc_nulls_last("o_orderdate"), F.desc("o_orderkey")).limit(100).select("o_orderkey", "o_orderstatus")


@query("SELECT CAST(i.pos AS INTEGER) AS pos, o_orderkey, o_orderstatus FROM orders JOIN (VALUES (0, 7), (1, 1), (2, 999999999), (3, 3)) i(pos, id) ON i.id = o_orderkey")
def lookup_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with given ids in the order of the ids; misses are dropped."""
    return queues.by_ids(table(spark, sf_dir, "orders"), "o_orderkey", [7, 1, 999999999, 3]).select("pos", "o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 33")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderkey = 33").select("o_orderkey", "o_custkey")


@query(f"""
SELECT o_orderkey FROM ({_JOBS}) WHERE o_orderpriority <> '2-HIGH'
ORDER BY CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END, o_orderdate, o_custkey NULLS LAST, o_orderkey LIMIT 20""")
def priority_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next jobs in claim order, without a blocked kind."""
    jobs = table(spark, sf_dir, "orders").where("o_orderpriority <> '2-HIGH'")
    return queues.claim(jobs, "o_orderstatus", "o_orderdate", "o_custkey", "o_orderkey", later="P", n=20).select("o_orderkey")


@query("""
SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderdate ORDER BY CASE WHEN o_custkey % 7 = 0 AND o_custkey % 5 > 0 THEN 0 ELSE 1 END, CASE WHEN o_custkey % 7 = 0 THEN -(o_custkey % 5) ELSE 0 END,
  CASE o_orderpriority WHEN '3-MEDIUM' THEN 0 WHEN '1-URGENT' THEN 1 ELSE 2 END, o_orderkey) AS place
FROM orders QUALIFY place <= 2""")
def priority_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two jobs of each day: retried ones first, then by the rank of their kind."""
    from pyspark.sql import Window as W

    jobs = table(spark, sf_dir, "orders").withColumn("retry", F.when(F.col("o_custkey") % 7 == 0, F.col("o_custkey") % 5).otherwise(0))
    order = queues.prioritised("retry", "o_orderpriority", ["3-MEDIUM", "1-URGENT"], "o_orderkey")
    place = F.row_number().over(W.partitionBy("o_orderdate").orderBy(*order))
    return jobs.withColumn("place", place.cast("long")).where("place <= 2").select("o_orderkey", "place")


@query("""
WITH d AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F'), t AS (SELECT count(*) AS total FROM orders)
SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT o_orderkey FROM d, t WHERE n > total - 9 * total // 10""")
def retention_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table held to nine tenths of its rows by dropping the oldest finished jobs."""
    orders = table(spark, sf_dir, "orders")
    return changes.capped(orders, "o_orderstatus", ["F"], 9 * orders.count() // 10, F.col("o_orderdate"), F.col("o_orderkey")).select("o_orderkey")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT (o_orderstatus IN ('F', 'P') AND o_orderdate < TIMESTAMP '1995-01-01')")
def expiry_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without old jobs in a terminal state."""
    return changes.not_expired(table(spark, sf_dir, "orders"), "o_orderstatus", ["F", "P"], "o_orderdate", F.lit("1995-01-01").cast("timestamp_ntz")).select("o_orderkey", "o_orderstatus")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's latest order."""
    return dedup.latest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderdate", F.col("o_orderkey"))


@query("SELECT lower(c_name) AS name, max(o_orderdate) AS last_time FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND o_orderdate IS NOT NULL GROUP BY 1")
def latest_success_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per lower-case name the last time of success."""
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F' and o_orderdate is not null").groupBy("o_custkey").agg(F.max("o_orderdate").alias("t"))
    return done.join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.lower("c_name").alias("name")).agg(F.max("t").alias("last_time"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return dedup.first_wins(events, ["user_id", "event_type"], F.col("ts"), F.col("event_id")).drop("ts")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return dedup.last_wins(events, ["user_id", "event_type"], F.col("ts"), F.col("event_id")).drop("ts")


@query("""
SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 ELSE 4 END, event_id) AS r FROM events) WHERE r = 1""")
def rank_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's event of the highest-ranked type, the first among equals."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return dedup.rank_wins(events, ["user_id"], "event_type", ["purchase", "signup", "click"], F.col("event_id"))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS r FROM events) WHERE r = 1")
def score_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.best_score(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "value", F.col("event_id"))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'view' THEN 1 ELSE 0 END, event_id) AS r FROM events) WHERE r = 1")
def placeholder_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's first event; a view stands only where there is nothing else."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return dedup.unless_placeholder(events, ["user_id"], F.col("event_type") == "view", F.col("event_id"))


@query("""
WITH old AS (SELECT p_partkey, p_name, p_size, p_brand FROM part WHERE p_partkey % 3 <> 0), new AS (SELECT p_partkey, upper(p_name) AS p_name, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size + 1 END AS p_size FROM part WHERE p_partkey % 2 = 0)
SELECT coalesce(n.p_partkey, o.p_partkey) AS p_partkey, CASE WHEN n.p_partkey IS NOT NULL THEN n.p_name ELSE o.p_name END AS p_name, CASE WHEN n.p_partkey IS NOT NULL THEN n.p_size ELSE o.p_size END AS p_size, o.p_brand, o.p_partkey IS NULL AS is_new
FROM old o FULL JOIN new n ON o.p_partkey = n.p_partkey""")
def shallow_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prior index with new rows on top; nulls replace too, other columns stay."""
    part = table(spark, sf_dir, "part")
    old = part.where("p_partkey % 3 <> 0").select("p_partkey", "p_name", "p_size", "p_brand")
    new = part.where("p_partkey % 2 = 0").select("p_partkey", F.upper("p_name").alias("p_name"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_size") + 1).alias("p_size"))
    return dedup.merged(old, new, "p_partkey", ["p_name", "p_size"])


@query("""
WITH delta AS (SELECT o_orderkey, 'X' AS o_orderstatus, o_totalprice + 1 AS o_totalprice, o_orderdate + INTERVAL 1 DAY AS o_orderdate FROM orders WHERE o_orderkey % 10 = 0
  UNION ALL SELECT o_orderkey + 100000000, 'N', o_totalprice, o_orderdate FROM orders WHERE o_orderkey % 50 = 0)
SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice, o_orderdate FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM delta)
UNION ALL SELECT d.o_orderkey, d.o_orderstatus, round(d.o_totalprice, 2), coalesce(o.o_orderdate, d.o_orderdate) FROM delta d LEFT JOIN orders o USING (o_orderkey)""")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows updated or inserted; the time of creation of a known key stays."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    known = orders.where("o_orderkey % 10 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"), (F.col("o_orderdate") + F.expr("interval 1 day")).alias("o_orderdate"))
    fresh = orders.where("o_orderkey % 50 = 0").select((F.col("o_orderkey") + 100000000).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), "o_totalprice", "o_orderdate")
    out = changes.upserted(orders, known.unionByName(fresh), ["o_orderkey"], F.col("o_orderkey"), keep_first=("o_orderdate",))
    return out.withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("""
WITH a AS (SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey % 5 <> 1), b AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 5 <> 2)
SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN a.p_partkey IS NULL THEN 'insert' WHEN b.p_partkey IS NULL THEN 'delete' ELSE 'update' END AS change
FROM a FULL JOIN b ON a.p_partkey = b.p_partkey WHERE a.p_partkey IS NULL OR b.p_partkey IS NULL OR a.p_name IS DISTINCT FROM b.p_name OR a.p_size IS DISTINCT FROM b.p_size""")
def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts, updates and deletes between two images of a table."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    before = part.where("p_partkey % 5 <> 1")
    after = part.where("p_partkey % 5 <> 2").withColumn("p_size", F.when(F.col("p_partkey") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return changes.change_feed(before, after, ["p_partkey"])


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5")
def keep_last_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five events of each user."""
    return changes.last_n(table(spark, sf_dir, "events"), ["user_id"], 5, F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type")
def changes_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of another type than the one before them."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return changes.changes_only(events, ["user_id"], "event_id", ["event_type"])


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS place, CAST((row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // 250 + 1 AS INTEGER) AS folder, lpad(CAST((row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // 250 + 1 AS VARCHAR), 6, '0') AS label FROM orders")
def queue_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every job's place in the whole queue, and the folder of 250 that holds it."""
    rows = changes.numbered(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("o_orderdate"), F.col("o_orderkey"), name="place")
    folder = queues.bucket(F.col("place"), 250)
    return rows.select("o_orderkey", "place", folder.alias("folder"), queues.bucket_label(folder, 6).alias("label"))


@query("SELECT conv_id, turn, CAST(turn // 8 AS BIGINT) AS win, CAST(count(*) OVER (PARTITION BY conv_id, turn // 8) AS BIGINT) AS in_window FROM conversations")
def window_of_eight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns dealt to windows of eight, with each window's size."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.floor(F.col("turn") / 8).alias("win"))
    return rows.join(rows.groupBy("conv_id", "win").agg(F.count("*").alias("in_window")), ["conv_id", "win"])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey % 5 < 3 THEN 'queued' ELSE 'error' END AS state FROM orders")
def interrupted_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of running jobs after a restart."""
    jobs = table(spark, sf_dir, "orders").withColumn("state", F.when(F.col("o_orderstatus") == "O", "running").otherwise(F.col("o_orderstatus")))
    return jobs.select("o_orderkey", queues.recovered(F.col("state"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("o_custkey") % 5).alias("state"))


@query("SELECT c_custkey, c_name FROM customer WHERE lower(concat_ws(' ', c_name, c_mktsegment)) LIKE '%build%' AND c_acctbal IS NOT NULL")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a phrase in some column."""
    return queues.searched(table(spark, sf_dir, "customer"), "BUILD", "c_name", "c_mktsegment").where("c_acctbal is not null").select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1994-12-31' OR o_orderdate IS NULL")
def time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.in_range(table(spark, sf_dir, "orders"), "o_orderdate", "1994-01-01", "1994-12-31", keep_null=True).select("o_orderkey", "o_orderstatus")


@query("SELECT event_id, user_id FROM (SELECT e.*, CASE event_type WHEN 'error' THEN 0 WHEN 'signup' THEN 1 ELSE 99 END AS k FROM events e) ORDER BY k, ts DESC, event_id LIMIT 40")
def state_rank_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results by the rank of their state, the newest first."""
    state = F.when(F.col("event_type") == "error", "running").when(F.col("event_type") == "signup", "completed").otherwise("other")
    events = table(spark, sf_dir, "events").withColumn("state", state)
    return events.orderBy(queues.state_rank(F.col("state")), F.desc("ts"), "event_id").limit(40).select("event_id", "user_id")


@query("""
WITH h AS (SELECT md5(concat_ws(chr(31), l_linenumber, l_linestatus, l_orderkey, l_partkey, l_returnflag, coalesce(CAST(l_suppkey AS VARCHAR), chr(0)))) AS h FROM lineitem),
q AS (SELECT count(*) AS n, sum(('0x' || h[1:8])::BIGINT::HUGEINT) AS a, sum(('0x' || h[9:16])::BIGINT::HUGEINT) AS b, sum(('0x' || h[17:24])::BIGINT::HUGEINT) AS c, sum(('0x' || h[25:32])::BIGINT::HUGEINT) AS d FROM h)
SELECT n, md5(concat_ws(',', n, a, b, c, d)) AS digest FROM q""")
def table_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and digest of a table's keys and flags, whatever the order of its rows."""
    return changes.fingerprint(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey % 4 = 0 AND p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 6 = 0)")
def idempotent_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a batch that are not there yet."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return changes.fresh_inserts(part.where("p_partkey % 6 = 0"), part.where("p_partkey % 4 = 0"), ["p_partkey"])

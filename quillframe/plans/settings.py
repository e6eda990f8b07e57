"""Queries over small values: settings, nested lists, JSON objects, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.functions import values
from quillframe.operators import tables
from quillframe.plans.registry import query, table


@query("SELECT o_custkey, count(*) AS n, CAST(sum(len(string_split(o_orderpriority, '-'))) AS BIGINT) AS total FROM orders GROUP BY o_custkey")
def nested_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum over a nested list of structs."""
    # A row's list is added up within the row, and the rows' sums by key.
    items = F.transform(F.split("o_orderpriority", "-"), lambda x: F.struct(F.lit(1).alias("n"), x.alias("part")))
    own = F.aggregate(items, F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(own).alias("total"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, '{' || string_agg('\"' || n_name || '\":\"' || n_nationkey || '\"', ',' ORDER BY n_name) || '}' AS keys FROM nation GROUP BY n_regionkey HAVING count(*) > 0")
def object_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in order as one string, and as a JSON object of keys."""
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_name", F.col("n_nationkey").cast("string").alias("k")))).alias("e"))
    return rows.select("n_regionkey", F.array_join(F.transform("e", lambda x: x["n_name"]), ",").alias("names"), F.to_json(F.map_from_entries("e")).alias("keys"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'w' || event_id ELSE 'x' || user_id END AS a, 'd' AS b, CASE WHEN event_id % 3 = 0 THEN 'z' END AS c FROM events")
def settings_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults under known own values under the worker's values."""
    text = lambda c: F.col(c).cast("string")
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    defaults = F.create_map(F.lit("a"), F.lit("d"), F.lit("b"), F.lit("d"))
    owned = F.create_map(F.lit("a"), F.concat(F.lit("x"), text("user_id")), F.lit("secret"), F.lit("s"))
    worker = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("a"), F.concat(F.lit("w"), text("event_id")))).otherwise(empty)
    worker = F.map_concat(worker, F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("c"), F.lit("z"))).otherwise(empty))
    m = values.settings(defaults, owned, worker, ["a", "b"])
    rows = table(spark, sf_dir, "events").withColumn("m", m)
    return rows.select("event_id", *(F.try_element_at("m", F.lit(k)).alias(k) for k in ("a", "b", "c")))


@query("SELECT o_orderkey, CAST((n - r) // 20 + 1 AS INTEGER) AS newest_page, CAST((r - 1) // 20 + 1 AS INTEGER) AS oldest_page FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)")
def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing page of each of a customer's orders, newest or oldest first."""
    from pyspark.sql import Window as W

    w = W.partitionBy("o_custkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(w.orderBy("o_orderkey")).alias("r"), F.count("*").over(w).alias("n"))
    return rows.select("o_orderkey", values.page_of(F.col("r"), F.col("n"), 20, True).alias("newest_page"), values.page_of(F.col("r"), F.col("n"), 20).alias("oldest_page"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 1000 = 7 THEN (SELECT max(o_custkey % 11) FROM orders) + row_number() OVER (PARTITION BY o_orderkey % 1000 = 7 ORDER BY o_orderkey) ELSE o_custkey % 11 END AS retry FROM orders")
def retry_bump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen jobs get priorities above all others."""
    jobs = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 11).alias("retry"))
    return tables.retried(jobs, F.col("o_orderkey") % 1000 == 7, "retry", F.col("o_orderkey"))


@query("SELECT event_type, round(coalesce(avg(value), 0), 6) AS mean, round(max(value), 6) AS peak, count(*) AS n FROM events GROUP BY event_type")
def latency_gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.groupBy("event_type").agg(F.round(F.coalesce(F.avg("value"), F.lit(0.0)), 6).alias("mean"), F.round(F.max("value"), 6).alias("peak"), F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey % 3 = 0 OR o_orderdate > TIMESTAMP '1996-06-01' AS live, o_orderstatus = 'O' AND o_orderdate > TIMESTAMP '1996-06-01' AS valid FROM orders")
def token_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows are not expired, and which are not revoked either."""
    now = F.lit("1996-06-01").cast("timestamp_ntz")
    expires = F.when(F.col("o_custkey") % 3 != 0, F.col("o_orderdate"))
    revoked = F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", values.is_live(expires, now).alias("live"), values.is_valid_token(F.col("o_orderdate"), revoked, now).alias("valid"))


@query("SELECT l_orderkey, bool_or(l_returnflag = 'A') AS has_a, bool_or(l_returnflag <> 'A') AS has_other FROM lineitem GROUP BY l_orderkey")
def asset_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the wanted files each item has."""
    files = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "A", "A").otherwise("other").alias("name"))
    return tables.probed(files.select("l_orderkey").distinct(), files, "l_orderkey", "name", ["a", "other"])

"""Queries that choose rows, fill fields and look items up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.operators import queues, selection
from quillframe.plans.registry import query, table


@query("""
SELECT p_partkey, p_name LIKE 'b%' OR p_name LIKE '%gear' OR p_name IN ('red widget') AS chosen,
       (p_name NOT IN ('blue bolt', 'hot gear') AND p_name NOT LIKE 'small%') AS left_over, p_partkey % 3 <> 0 AS has_size, CASE WHEN p_partkey % 3 = 0 THEN 'name' ELSE 'name,size' END AS others
FROM part""")
def key_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by patterns and lists, and the keys that JSON objects have, known ones left out."""
    part = table(spark, sf_dir, "part").where("p_name is not null")
    fields = F.struct(F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_size")).alias("size"), F.lit(1).alias("theme"), F.lit(2).alias("auto_audio_x"))
    rows = part.select("p_partkey", "p_name", F.to_json(fields).alias("doc"))
    unknown = selection.unknown_keys(rows, "doc", ("theme",), ("auto_audio_%",)).groupBy("p_partkey").agg(F.array_join(F.array_sort(F.collect_list("key")), ",").alias("others"))
    chosen = selection.named("p_name", also=("red widget",), like=("b%", "%gear"))
    left = selection.named("p_name", never=("blue bolt", "hot gear"), unlike=("small%",))
    return rows.join(unknown, "p_partkey", "left").select("p_partkey", chosen.alias("chosen"), left.alias("left_over"), selection.has_key("doc", "size").alias("has_size"), "others")


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS id, trim(p_name) AS title, 'writer ' || p_size AS author, CASE WHEN p_partkey % 4 < 2 THEN CAST(p_size AS BIGINT) END AS segments,
       CASE WHEN p_partkey % 5 = 0 THEN CAST(p_partkey AS DOUBLE) WHEN p_partkey % 5 = 1 THEN p_partkey + 0.5 END AS rating, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS BIGINT) END AS reviews
FROM part WHERE p_partkey % 3 <> 1 AND p_partkey % 7 <> 2 AND p_name <> ''""")
def completed_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The completed series of payloads, whose counts must be whole numbers and not texts."""
    k, size = F.col("p_partkey"), F.col("p_size")
    text, number = (lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"'))), (lambda c: c.cast("string"))
    count = F.when(k % 4 < 2, number(size)).when(k % 4 == 2, text(size)).otherwise(F.concat(number(size), F.lit(".5")))
    rating = F.when(k % 5 == 0, number(k)).when(k % 5 == 1, F.concat(number(k), F.lit(".5"))).when(k % 5 == 2, text(k)).otherwise("null")
    fields = {
        "id": F.when(k % 2 == 0, number(k)).otherwise(text(k)), "title": text(F.concat(F.lit(" "), "p_name", F.lit("  "))), "story_status": F.when(k % 3 == 1, F.lit('"ongoing"')).otherwise('"Complete"'),
        "for_patrons_only": F.when(k % 7 == 2, "true").when(k % 7 == 3, F.lit('"true"')).otherwise("false"), "chapters_count": count, "overall_rating_cache": rating,
        "reviews_count": F.when(k % 2 == 0, number(k)).otherwise(text(k)), "user": F.concat(F.lit('{"name": "", "username": "writer '), number(size), F.lit('"}')),
    }
    story = F.concat(F.lit("{"), F.concat_ws(", ", *(F.concat(F.lit(f'"{n}": '), c) for n, c in fields.items())), F.lit("}"))
    payloads = table(spark, sf_dir, "part").where("p_name is not null").groupBy(F.floor(k / 10).alias("page")).agg(F.concat(F.lit('{"stories": ['), F.array_join(F.collect_list(story), ", "), F.lit("]}")).alias("payload"))
    return selection.completed_refs(payloads, "payload")


@query("WITH j AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'processing' ELSE 'done' END AS state FROM orders) SELECT o_orderkey, state, count(*) OVER (PARTITION BY state) AS in_list FROM j WHERE state <> 'done'")
def queue_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running and waiting jobs of one table, each with the length of its list."""
    state = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "processing").otherwise("done")
    return selection.queue_lists(table(spark, sf_dir, "orders").select("o_orderkey", state.alias("state")), "state")


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON lower(c_name) = lower(replace(s_name, 'Supplier', 'Customer')) WHERE c_name IS NOT NULL")
def same_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of two tables with the same address, however it was written."""
    users = table(spark, sf_dir, "customer").select("c_custkey", selection.email_key(F.concat(F.lit("  "), F.upper("c_name"), F.lit("@X.org "))).alias("address"))
    others = table(spark, sf_dir, "supplier").select("s_suppkey", selection.email_key(F.concat(F.replace(F.col("s_name"), F.lit("Supplier"), F.lit("Customer")), F.lit("@x.ORG"))).alias("address"))
    return users.where("address <> ''").join(others, "address").select("c_custkey", "s_suppkey")


@query("SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag <> 'A' OR l_linestatus = 'O' OR l_partkey % 3 = 0) AS free, count(*) FILTER (WHERE NOT (l_returnflag <> 'A' OR l_linestatus = 'O' OR l_partkey % 3 = 0)) AS paid FROM lineitem GROUP BY 1")
def readable_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of each item that are free or unlocked, and those that are not."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_returnflag") == "A").alias("charge"), ((F.col("l_linestatus") == "O") | (F.col("l_partkey") % 3 == 0)).alias("unlock"))
    return selection.access_counts(lines, "l_orderkey", "charge", "unlock")


@query("""
SELECT o_orderkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AND o_orderstatus <> 'F' AS revoked_now,
       CASE WHEN o_orderstatus = 'F' THEN o_orderdate WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN TIMESTAMP '2001-01-01' END AS revoked_at FROM orders""")
def revoked_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens after those of some users were revoked; earlier revocations keep their time."""
    tokens = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("revoked_at"))
    users = table(spark, sf_dir, "customer").where("c_acctbal < 0")
    return selection.revoked(tokens, users, "c_custkey", "revoked_at", F.lit("2001-01-01").cast(tokens.schema["revoked_at"].dataType)).select("o_orderkey", "revoked_now", "revoked_at")


@query("""
WITH s AS (SELECT l_orderkey, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber ELSE l_linenumber + 1 END AS number, CASE WHEN l_partkey % 4 = 0 THEN 'i' || l_suppkey ELSE 'c' || l_partkey END AS id, l_linenumber::BIGINT * 1000000000 + l_partkey AS o FROM lineitem WHERE l_partkey % 5 <> 0 OR l_partkey % 4 = 0)
SELECT l_orderkey, CAST(number AS INTEGER) AS number, id FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, number ORDER BY o DESC, id DESC) AS r FROM s WHERE number IN (2, 4)) WHERE r = 1""")
def segment_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the segments with the wanted numbers, from whichever field has them."""
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.select("l_orderkey", F.when(n % 2 == 0, n).otherwise(0).alias("index"), F.when(n % 2 == 1, n + 1).alias("ordinal"), F.when(p % 4 == 0, "").when(p % 5 != 0, F.concat(F.lit("c"), p)).alias("chapter_id"), F.when(p % 4 == 0, F.concat(F.lit("i"), "l_suppkey")).alias("id"), (n.cast("long") * 1000000000 + p).alias("o"))
    wanted = lines.select("l_orderkey", F.explode(F.array(F.lit(2), F.lit(4))).alias("number"))
    return selection.id_map(rows, "l_orderkey", ("index", "ordinal"), ("chapter_id", "id"), "o", wanted)


@query("""
WITH s AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), f AS (SELECT s.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS r FROM s LEFT JOIN (SELECT o_orderkey, CAST(o_orderkey % 4 AS INTEGER) AS start FROM orders WHERE o_orderkey % 4 > 0) ON o_orderkey = l_orderkey WHERE l_linenumber >= coalesce(start, 1))
SELECT l_orderkey, l_linenumber, 'range' AS how FROM s WHERE l_linenumber BETWEEN 2 AND 3 UNION ALL SELECT l_orderkey, l_linenumber, 'start' FROM f WHERE r <= 2""")
def chosen_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of a range, and the first two from each item's start on."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    starts = table(spark, sf_dir, "orders").where("o_orderkey % 4 > 0").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 4).alias("start"))
    one = selection.chosen_segments(lines, "l_orderkey", "l_linenumber", "2-3").withColumn("how", F.lit("range"))
    return one.unionByName(selection.chosen_segments(lines, "l_orderkey", "l_linenumber", starts=starts, limit=2).withColumn("how", F.lit("start")))


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS r FROM orders WHERE o_orderstatus = 'O') WHERE r <= greatest(0, 1000 - (SELECT count(*) FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 97 = 0))")
def admitted_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest waiting jobs, as many as there is room for beside those that run."""
    orders = table(spark, sf_dir, "orders")
    return selection.admitted(orders.where("o_orderstatus = 'O'"), orders.where("o_orderstatus = 'P' and o_orderkey % 97 = 0"), 1000, F.col("o_orderdate"), F.col("o_orderkey")).select("o_orderkey")


@query("""
SELECT p_partkey, coalesce(CASE WHEN p_partkey % 4 <> 0 THEN p_name END, 'brand ' || p_brand) AS title, coalesce(CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN NULL ELSE p_type END, CASE WHEN p_partkey % 4 <> 0 THEN p_name END, 'none') AS label,
       'cover-' || p_partkey || '-' || CASE WHEN p_size % 3 = 0 THEN 'no_cover_file' WHEN p_size % 3 = 1 THEN 'updated' ELSE 'failed' END AS id, CASE WHEN p_partkey % 5 = 0 THEN 'enc:' || p_brand ELSE 'enc:' || md5(p_brand) END AS value
FROM part WHERE p_name IS NOT NULL AND p_brand IS NOT NULL AND p_type IS NOT NULL""")
def defaulted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose gaps are filled from other fields, with ids of their own, and values that are marked once."""
    part, k = table(spark, sf_dir, "part").where("p_name is not null and p_brand is not null and p_type is not null"), F.col("p_partkey")
    rows = part.select("p_partkey", "p_size", "p_brand", F.when(k % 4 != 0, F.col("p_name")).alias("title"), F.when(k % 3 == 1, "").when(k % 3 == 2, F.col("p_type")).alias("label"), F.when(k % 5 == 0, F.concat(F.lit("enc:"), "p_brand")).otherwise(F.col("p_brand")).alias("value"))
    rows = selection.defaulted(rows, {"title": [F.concat(F.lit("brand "), "p_brand")], "label": ["title", F.lit("none")]})
    state = F.when(F.col("p_size") % 3 == 0, "no_cover1_file").when(F.col("p_size") % 3 == 1, "updated").otherwise("failed")
    return rows.select("p_partkey", "title", "label", selection.history_id("cover", F.col("p_partkey").cast("string"), state, {"no_cover1_file": "no_cover_file"}).alias("id"), selection.marked("value", "enc:", F.md5("value")).alias("value"))


@query("""
WITH i AS (SELECT c_name AS name, min(c_custkey) AS item FROM customer WHERE c_custkey % 4 <> 0 GROUP BY 1), t AS (SELECT c_nationkey AS title, min(c_custkey) AS target FROM customer WHERE c_nationkey % 3 <> 0 GROUP BY 1),
r AS (SELECT n.name, i.item, t.target FROM (SELECT DISTINCT c_name AS name FROM customer WHERE c_name IS NOT NULL) n LEFT JOIN i ON n.name = i.name LEFT JOIN customer c ON c.c_custkey = i.item LEFT JOIN t ON t.title = c.c_nationkey),
s AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT name, item, target, CASE WHEN item IS NULL THEN 'no_folder' WHEN target IS NULL THEN 'no_target' ELSE 'ready' END AS outcome, CASE WHEN item IS NOT NULL AND target IS NOT NULL THEN coalesce(n, 0) ELSE 0 END AS total FROM r LEFT JOIN s ON o_custkey = item""")
def resolved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that someone has given: the items they stand for, these items' targets, and how many segments are ready."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("item"), F.col("c_nationkey").alias("title"))
    targets = customers.where("title % 3 <> 0").select("title", F.col("item").alias("target"))
    return selection.resolved(customers.where("name is not null"), customers.where("item % 4 <> 0"), targets, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("item")), "name", "title")


@query("SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY CASE p_brand WHEN 'Brand#3' THEN 0 WHEN 'Brand#1' THEN 1 ELSE 2 END, lower(p_name), p_partkey) AS r FROM part) WHERE r <= 200")
def category_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows by their category's rank, then by title in lower case."""
    part = table(spark, sf_dir, "part").withColumn("retry", F.lit(0)).withColumn("title", F.lower("p_name"))
    return part.orderBy(*queues.prioritised("retry", "p_brand", ["Brand#3", "Brand#1"], "title"), "p_partkey").limit(200).select("p_partkey")

"""Queries over series and segments: joins, duplicates, gaps, reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.functions.names import differences, same_set
from quillframe.functions.text import title_key
from quillframe.operators import compare, reconcile, segments
from quillframe.plans.registry import query, table


def _images(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two images of the segments: one row per order and line, the second with lines left out, added and changed."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("quantity"))
    left = lines.where("l_linenumber <= 5").withColumnRenamed("quantity", "left_quantity")
    right = lines.where("l_linenumber >= 2").select("l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 3 == 0, F.col("quantity") + 1).otherwise(F.col("quantity")).alias("right_quantity"))
    return left, right


_IMAGES = """
WITH g AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
l AS (SELECT l_orderkey, l_linenumber, q AS left_quantity FROM g WHERE l_linenumber <= 5),
r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 = 0 THEN q + 1 ELSE q END AS right_quantity FROM g WHERE l_linenumber >= 2),
c AS (SELECT coalesce(l.l_orderkey, r.l_orderkey) AS l_orderkey, coalesce(l.l_linenumber, r.l_linenumber) AS l_linenumber,
  CASE WHEN r.l_orderkey IS NULL THEN 'missing_right' WHEN l.l_orderkey IS NULL THEN 'right_only' WHEN left_quantity = right_quantity THEN 'same' ELSE 'different' END AS outcome
  FROM l FULL JOIN r ON l.l_orderkey = r.l_orderkey AND l.l_linenumber = r.l_linenumber)
"""


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')")
def anti_exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a recent order."""
    recent = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp_ntz'1998-01-01'").select(F.col("o_custkey").alias("c_custkey"))
    return compare.absent(table(spark, sf_dir, "customer").select("c_custkey"), recent, ["c_custkey"])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def semi_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with lines."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return compare.present(table(spark, sf_dir, "orders").select("o_orderkey"), lines, ["o_orderkey"])


@query("""
SELECT p_name, 'left' AS side FROM (SELECT p_name FROM part WHERE p_partkey % 97 = 0 EXCEPT SELECT p_name FROM part WHERE p_partkey % 89 = 1)
UNION ALL SELECT p_name, 'right' FROM (SELECT p_name FROM part WHERE p_partkey % 89 = 1 EXCEPT SELECT p_name FROM part WHERE p_partkey % 97 = 0)""")
def both_ways_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names on one side only."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    left, right = (part.where(w).select("p_name").distinct() for w in ("p_partkey % 97 = 0", "p_partkey % 89 = 1"))
    return compare.absent_either_way(left, right, ["p_name"])


@query("""
SELECT o_custkey AS custkey, 'left' AS side FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)
UNION ALL SELECT c_custkey, 'right' FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)""")
def both_ways_absent_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of orders or of the customer table only; every row of both is compared."""
    left = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey")).distinct()
    right = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey")).distinct()
    return compare.absent_either_way(left, right, ["custkey"])


@query("""
SELECT p_partkey FROM part p WHERE p_partkey % 3 <> 0 AND p_name IN (SELECT p_name FROM part WHERE p_size > 30) AND NOT EXISTS (SELECT 1 FROM part e WHERE e.p_partkey % 300 = 0 AND e.p_name = p.p_name)""")
def wrong_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of another kind whose title is known and has no sibling of the right kind."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    stray = compare.present(part.where("p_partkey % 3 <> 0"), part.where("p_size > 30"), ["p_name"])
    return compare.absent(stray, part.where("p_partkey % 300 = 0"), ["p_name"]).select("p_partkey")


@query(_IMAGES + "SELECT l_orderkey, l_linenumber, outcome FROM c")
def full_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of two images: same, different, missing on the right, on the right only."""
    left, right = _images(spark, sf_dir)
    return compare.compared(left, right, ["l_orderkey", "l_linenumber"], F.col("left_quantity") == F.col("right_quantity")).select("l_orderkey", "l_linenumber", "outcome")


@query(_IMAGES + """
SELECT l_orderkey, CASE WHEN count(*) FILTER (WHERE outcome = 'different') > 0 THEN 'can_update'
  WHEN count(*) FILTER (WHERE outcome = 'same') > 0 AND count(*) FILTER (WHERE outcome IN ('missing_right', 'right_only')) = 0 THEN 'all_match' ELSE 'empty_chapters' END AS outcome
FROM c GROUP BY l_orderkey""")
def title_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each item from the comparison of its segments."""
    left, right = _images(spark, sf_dir)
    return reconcile.title_outcome(compare.compared(left, right, ["l_orderkey", "l_linenumber"], F.col("left_quantity") == F.col("right_quantity")), "l_orderkey")


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey AND (a.s_acctbal - b.s_acctbal) ** 2 + (a.s_nationkey * 100.0 - b.s_nationkey * 100.0) ** 2 <= 40000")
def theta_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of points within a radius."""
    points = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", (F.col("s_nationkey") * 100.0).alias("y"))
    return compare.near(points, "s_suppkey", "s_acctbal", "y", 200.0)


@query("""
WITH a AS (SELECT p_partkey AS k, p_size AS low, p_size + p_partkey % 7 AS high FROM part WHERE p_partkey % 10 = 0), b AS (SELECT p_partkey AS k, p_size AS low, p_size + p_partkey % 5 AS high FROM part WHERE p_partkey % 10 = 3)
SELECT a.k AS a_k, b.k AS b_k FROM a JOIN b ON a.low <= b.high AND b.low <= a.high""")
def range_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of overlapping ranges."""
    part = table(spark, sf_dir, "part")
    a = part.where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("long").alias("low"), (F.col("p_size") + F.col("p_partkey") % 7).alias("high"))
    b = part.where("p_partkey % 10 = 3").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("long").alias("low"), (F.col("p_size") + F.col("p_partkey") % 5).alias("high"))
    return compare.overlapping(a, b, "low", "high", 8).select("a_k", "b_k")


@query("""
WITH a AS (SELECT p_partkey AS k, p_partkey AS low, p_partkey + p_size % 7 AS high FROM part), b AS (SELECT p_partkey AS k, p_partkey + p_size % 3 AS low, p_partkey + p_size AS high FROM part)
SELECT a.k AS a_k, b.k AS b_k FROM a JOIN b ON a.low <= b.high AND b.low <= a.high""")
def range_overlap_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of overlapping ranges of all parts; a range meets as many others as its length allows, not a share of the table."""
    part = table(spark, sf_dir, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    a = part.select(k.alias("k"), k.alias("low"), (k + size % 7).alias("high"))
    b = part.select(k.alias("k"), (k + size % 3).alias("low"), (k + size).alias("high"))
    return compare.overlapping(a, b, "low", "high", 8).select("a_k", "b_k")


@query("SELECT r_name, n_name, count(c_custkey) AS customers FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent, child and number of grandchildren."""
    counts = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    rows = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).join(counts, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.select("r_name", "n_name", F.coalesce("customers", F.lit(0)).alias("customers"))


@query("SELECT p_partkey, coalesce(a.s_name, b.s_name) AS s_name FROM part LEFT JOIN (SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 2 = 0) a ON p_partkey = s_suppkey LEFT JOIN (SELECT s_nationkey AS k, min(s_name) AS s_name FROM supplier GROUP BY 1) b ON p_size = b.k")
def fallback_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name found by id, or else by a second key."""
    supplier = table(spark, sf_dir, "supplier")
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("s_nationkey"), F.col("p_partkey").alias("s_suppkey"))
    by_title = supplier.groupBy("s_nationkey").agg(F.min("s_name").alias("s_name"))
    return compare.with_fallback(part, supplier.where("s_suppkey % 2 = 0"), by_title, "s_suppkey", "s_nationkey", "s_name").select("p_partkey", "s_name")


@query("SELECT key, count(*) AS n, sum(CAST(json_extract_string(props, '$.' || key) AS BIGINT))::BIGINT AS total FROM (SELECT props, unnest(json_keys(props)) AS key FROM events) GROUP BY key")
def lateral_json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a JSON column with how often they occur and the sum of their values."""
    entries = table(spark, sf_dir, "events").select(F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return entries.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("value").try_cast("bigint")).alias("total"))


@query("SELECT lower(trim(p_name)) AS key, count(*) AS n, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS members FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of several parts, with these in order."""
    found = segments.duplicate_groups(table(spark, sf_dir, "part"), title_key("p_name"), F.col("p_partkey"))
    return found.select("key", "n", F.array_join("members", ",").alias("members"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.duplicate_ordinals(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("""
WITH o AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), r AS (SELECT l_orderkey, min(l_linenumber) AS first, max(l_linenumber) AS last, count(*) AS present FROM o GROUP BY 1),
m AS (SELECT l_orderkey, unnest(generate_series(first, last)) AS n FROM r)
SELECT r.l_orderkey, first, last, (SELECT count(*) FROM lineitem l WHERE l.l_orderkey = r.l_orderkey) AS segments,
  coalesce((SELECT string_agg(CAST(m.n AS VARCHAR), ',' ORDER BY m.n) FROM m LEFT JOIN o ON o.l_orderkey = m.l_orderkey AND o.l_linenumber = m.n WHERE m.l_orderkey = r.l_orderkey AND o.l_orderkey IS NULL), '') AS missing
FROM r""")
def gap_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order the missing line numbers between the first and the last."""
    per = segments.ordinal_summary(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")
    return per.select("l_orderkey", "first", "last", "segments", F.array_join("missing", ",").alias("missing"))


@query("SELECT conv_id, min(turn) AS first, max(turn) AS last, count(*) AS segments FROM conversations GROUP BY 1 HAVING count(DISTINCT turn) = max(turn) - min(turn) + 1")
def gap_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations without a gap."""
    return segments.ordinal_summary(table(spark, sf_dir, "conversations"), "conv_id", "turn").where("size(missing) = 0").select("conv_id", "first", "last", "segments")


@query("SELECT o_orderkey, coalesce(max(l_linenumber) FILTER (WHERE l_linenumber > 2), nullif(CAST(o_orderkey % 3 AS INTEGER), 0), 0) AS true_max FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def true_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highest ordinal of the live list, or else the count, or 0."""
    live = table(spark, sf_dir, "lineitem").where("l_linenumber > 2").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linenumber").alias("live"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey").join(live, "o_orderkey", "left")
    return rows.select("o_orderkey", segments.true_max(F.col("live"), (F.col("o_orderkey") % 3).cast("int")).alias("true_max"))


@query("""
SELECT source, count(*) FILTER (WHERE l.doc_id IS NULL) AS missing, count(*) AS total, coalesce(string_agg(CAST(d.doc_id AS VARCHAR), ',' ORDER BY d.doc_id) FILTER (WHERE l.doc_id IS NULL), '') AS ordinals
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY source HAVING count(*) FILTER (WHERE l.doc_id IS NULL) > 0""")
def missing_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source the documents without a label."""
    found = segments.missing_segments(table(spark, sf_dir, "documents").select("source", "doc_id"), table(spark, sf_dir, "labels"), "source", "doc_id", "doc_id")
    return found.select("source", "missing", "total", F.array_join("ordinals", ",").alias("ordinals"))


@query("SELECT conv_id, count(*) AS segments, string_agg('## ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def series_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as one text, its turns in order."""
    return segments.combined(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role"), F.col("text"))


@query("""
WITH b AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand END AS lb, p_brand || CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE '' END AS rb, p_size AS ls, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS rs FROM part)
SELECT p_partkey, concat_ws(';', CASE WHEN lb IS NOT NULL AND lb <> rb THEN 'brand:' || lb || '>' || rb END, CASE WHEN ls <> rs THEN 'size:' || ls || '>' || rs END) AS diff FROM b""")
def field_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that differ between two images, in a fixed order."""
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    pairs = [
        ("brand", F.when(k % 4 != 0, F.col("p_brand")), F.concat("p_brand", F.when(k % 3 == 0, "x").otherwise(""))),
        ("size", F.col("p_size"), F.when(k % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))),
    ]
    text = F.array_join(F.transform(differences(pairs), lambda d: F.concat(d["field"], F.lit(":"), d["left"], F.lit(">"), d["right"])), ";")
    return part.select("p_partkey", text.alias("diff"))


@query("SELECT p_partkey, list_sort(list_distinct(string_split(lower(p_name), ' '))) = list_sort(list_distinct(string_split(lower(CASE WHEN p_partkey % 2 = 0 THEN array_to_string(list_reverse(string_split(p_name, ' ')), ' ') ELSE p_name || ' z' END), ' '))) AS same FROM part")
def tag_set_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Are two lists of tags the same set?"""
    tags = F.split("p_name", " ")
    other = F.when(F.col("p_partkey") % 2 == 0, F.reverse(F.transform(tags, F.upper))).otherwise(F.array_append(tags, F.lit("z")))
    return table(spark, sf_dir, "part").select("p_partkey", same_set(tags, other).alias("same"))


def _library(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Source items, targets and segment facts that the orders and their lines stand for."""
    orders = table(spark, sf_dir, "orders")
    items = orders.select(
        F.col("o_orderkey").alias("item"),
        F.when(F.col("o_orderstatus") == "O", "EXTENDED").when(F.col("o_orderstatus") == "F", "DONE").otherwise("ING").alias("prefix"),
        # A few items share a title.
        F.when(F.col("o_orderkey") % 37 == 0, F.floor(F.col("o_orderkey") / 74) * 1000000000).otherwise(F.col("o_orderkey")).alias("title"),
        (F.col("o_orderkey") % 13 != 0).alias("valid_name"),
    )
    targets = items.where("item % 11 <> 0").groupBy("title").agg(F.max(F.col("item") % 5).cast("int").alias("true_max"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("ordinal"), (F.col("l_partkey") % 29 != 0).alias("valid"))
    return items, targets, reconcile.segment_facts(lines, "item", "ordinal", "valid")


_LIBRARY = """
WITH items AS (SELECT o_orderkey AS item, CASE o_orderstatus WHEN 'O' THEN 'EXTENDED' WHEN 'F' THEN 'DONE' ELSE 'ING' END AS prefix,
  CASE WHEN o_orderkey % 37 = 0 THEN (o_orderkey // 74) * 1000000000 ELSE o_orderkey END AS title, o_orderkey % 13 <> 0 AS valid_name FROM orders),
targets AS (SELECT title, CAST(max(item % 5) AS INTEGER) AS true_max FROM items WHERE item % 11 <> 0 GROUP BY title),
each_one AS (SELECT l_orderkey AS item, l_linenumber AS ordinal, count(*) AS n, bool_or(l_partkey % 29 <> 0) AS good, count(*) FILTER (WHERE l_partkey % 29 = 0) AS bad FROM lineitem GROUP BY 1, 2),
facts AS (SELECT item, count(*) FILTER (WHERE n > 1) AS repeated, sum(bad) AS bad_files, min(ordinal) AS first, sum(n) AS segments FROM each_one GROUP BY 1),
"""


@query(_LIBRARY + """
ext AS (SELECT item, title, false AS stray FROM items WHERE prefix = 'EXTENDED'
  UNION ALL SELECT item, title, true FROM items WHERE prefix <> 'EXTENDED' AND title IN (SELECT title FROM targets) AND title NOT IN (SELECT title FROM items WHERE prefix = 'EXTENDED')),
shared AS (SELECT title FROM ext GROUP BY title HAVING count(*) > 1),
fresh AS (SELECT e.item, min(s.ordinal) AS lo, max(s.ordinal) AS hi, count(s.ordinal) AS n FROM ext e JOIN targets t USING (title) JOIN each_one s ON s.item = e.item AND s.good AND s.ordinal > t.true_max GROUP BY 1)
SELECT item, outcome, CASE WHEN outcome = 'updatable' THEN CAST(n AS INTEGER) ELSE 0 END AS new_segments FROM (SELECT e.item, n.n, CASE WHEN e.title IN (SELECT title FROM shared) THEN 'invalid_title' WHEN stray THEN 'wrong_prefix' WHEN true_max IS NULL THEN 'no_server_match' WHEN repeated > 0 THEN 'invalid_duplicate'
  WHEN bad_files > 0 THEN 'invalid_filename' WHEN coalesce(segments, 0) = 0 THEN 'empty_extended' WHEN n.n IS NULL THEN 'no_update_needed' WHEN lo <> true_max + 1 THEN 'start_mid_series' WHEN hi - lo + 1 <> n.n THEN 'non_sequential' ELSE 'updatable' END AS outcome
FROM ext e LEFT JOIN targets t USING (title) LEFT JOIN facts f ON f.item = e.item LEFT JOIN fresh n ON n.item = e.item)""")
def reconcile_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which source items may extend their targets, and by how many segments."""
    return reconcile.update_eligibility(*_library(spark, sf_dir))


@query(_LIBRARY + """
shared AS (SELECT title FROM items WHERE prefix = 'DONE' GROUP BY title HAVING count(*) > 1), known AS (SELECT title FROM targets WHERE title % 3 = 0),
span AS (SELECT item, max(ordinal) - min(ordinal) + 1 - count(*) AS holes FROM each_one WHERE good GROUP BY item)
SELECT item, outcome, CASE WHEN outcome = 'uploadable' THEN CAST(coalesce(holes, 0) AS INTEGER) END AS missing FROM (SELECT i.item, holes, CASE WHEN prefix <> 'DONE' THEN 'not_ready' WHEN i.title IN (SELECT title FROM shared) THEN 'invalid_title' WHEN i.title IN (SELECT title FROM known) THEN 'already_on_server' WHEN NOT valid_name THEN 'invalid_source'
  WHEN repeated > 0 THEN 'invalid_duplicate' WHEN bad_files > 0 THEN 'invalid_filename' WHEN first <> 1 THEN 'invalid_first' ELSE 'uploadable' END AS outcome
FROM items i LEFT JOIN facts f ON f.item = i.item LEFT JOIN span s ON s.item = i.item)""")
def upload_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which source items may be uploaded, with how many segments they lack."""
    items, targets, facts = _library(spark, sf_dir)
    return reconcile.upload_eligibility(items, targets.where("title % 3 = 0"), facts).withColumn("missing", F.when(F.col("missing").isNotNull(), F.size("missing")))


@query(_LIBRARY + """
x AS (SELECT 1)
SELECT i.item, CASE WHEN i.item % 4 = 0 THEN 'no_file' WHEN t.title IS NULL THEN 'no_server_match' WHEN i.item % 3 = 0 THEN 'updated' ELSE 'can_update' END AS outcome FROM items i LEFT JOIN targets t USING (title)""")
def asset_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each item's asset."""
    items, targets, _ = _library(spark, sf_dir)
    rows = items.join(targets, "title", "left")
    return rows.select("item", reconcile.asset_outcome(F.col("item") % 4 != 0, F.col("true_max").isNotNull(), F.when(F.col("item") % 3 == 0, "updated")).alias("outcome"))


@query(_LIBRARY + """
s AS (SELECT e.item, e.ordinal, coalesce(t.true_max, 0) AS m FROM each_one e JOIN items USING (item) LEFT JOIN targets t USING (title))
SELECT item, ordinal FROM (SELECT item, ordinal, row_number() OVER (PARTITION BY item ORDER BY ordinal) AS r FROM s WHERE ordinal > m) WHERE r <= 3""")
def sync_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments to post next, three per item at most."""
    items, targets, _ = _library(spark, sf_dir)
    maxima = items.join(targets, "title").select("item", "true_max")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("ordinal")).distinct().withColumn("segment", F.col("ordinal"))
    return reconcile.sync_plan(lines, maxima, "item", "ordinal", 3).select("item", "ordinal")

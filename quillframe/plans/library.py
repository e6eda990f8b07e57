"""Compound queries over a library and its target, and over runs: eligibility, metadata, contents, search, audio, slots, rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.operators import compare, queues, reconcile, segments, telemetry
from quillframe.plans.registry import query, table
from quillframe.plans.series import _LIBRARY, _library
from quillframe.plans.signals import _rows
from quillframe.streaming import runs


@query(_LIBRARY + """
fin AS (SELECT DISTINCT title FROM items WHERE item % 4 = 0), mine AS (SELECT i.* FROM items i JOIN fin USING (title) WHERE item % 6 <> 1),
ext AS (SELECT item, title, false AS stray FROM mine WHERE prefix = 'EXTENDED'
  UNION ALL SELECT item, title, true FROM mine WHERE prefix <> 'EXTENDED' AND title IN (SELECT title FROM targets) AND title NOT IN (SELECT title FROM mine WHERE prefix = 'EXTENDED')),
shared AS (SELECT title FROM ext WHERE NOT stray GROUP BY title HAVING count(*) > 1), m AS (SELECT e.*, coalesce(t.true_max, 0) AS top FROM ext e LEFT JOIN targets t USING (title)),
fresh AS (SELECT m.item, min(s.ordinal) AS lo, max(s.ordinal) AS hi, count(*) AS n FROM m JOIN each_one s ON s.item = m.item AND s.good AND s.ordinal > m.top GROUP BY 1),
o AS (SELECT m.title, m.item, n, CASE WHEN stray THEN 'wrong_prefix' WHEN m.title IN (SELECT title FROM shared) THEN 'invalid_title' WHEN repeated > 0 THEN 'invalid_duplicate' WHEN bad_files > 0 THEN 'invalid_filename' WHEN coalesce(segments, 0) = 0 THEN 'empty_extended'
  WHEN n IS NULL THEN 'no_update_needed' WHEN lo <> top + 1 THEN 'start_mid_series' WHEN hi - lo + 1 <> n THEN 'non_sequential' ELSE 'updatable' END AS outcome FROM m LEFT JOIN facts f ON f.item = m.item LEFT JOIN fresh r ON r.item = m.item)
SELECT title, item, outcome, CASE WHEN outcome = 'updatable' THEN CAST(n AS INTEGER) ELSE 0 END AS new_segments FROM o
UNION ALL SELECT title, NULL, 'no_drive_folder', 0 FROM fin WHERE title IN (SELECT title FROM targets) AND title NOT IN (SELECT title FROM ext)""")
def finished_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series that readers have finished: which items may extend them, and which have none."""
    items, targets, facts = _library(spark, sf_dir)
    finished = items.where("item % 4 = 0").select("title")
    return reconcile.finished_eligibility(items.where("item % 6 <> 1"), targets, facts, finished)


_META = """
WITH p AS (SELECT p_partkey AS k, p_name, lower(p_brand) AS brand, p_size AS size FROM part),
m AS (SELECT *, k % 6 = 0 AS other_sub, k % 9 = 0 AS fewer_tags FROM p)
"""


@query(_META + """
SELECT k AS item, CASE WHEN k % 10 = 9 THEN 'no_server_match' WHEN fields <> '' THEN 'can_update' ELSE 'all_match' END AS outcome, CASE WHEN k % 10 <> 9 AND fields <> '' THEN fields END AS fields
FROM (SELECT k, concat_ws(',', CASE WHEN other_sub THEN 'category' END, CASE WHEN k % 4 <> 0 AND size % 7 <> CASE WHEN k % 8 = 1 THEN 0 ELSE size % 7 END THEN 'free_chapters_count' END,
  CASE WHEN k % 3 = 0 AND k % 5 <> k % 4 THEN 'push' END, CASE WHEN k % 5 <> 0 AND k % 11 = 0 THEN 'synopsis' END, CASE WHEN fewer_tags THEN 'tags' END,
  CASE WHEN k % 2 = 0 AND size <> CASE WHEN k % 12 = 0 THEN 0 ELSE size END THEN 'max_chapter' END, CASE WHEN k % 7 = 0 AND k % 14 <> 0 THEN 'length' END) AS fields FROM m)""")
def metadata_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose metadata differ from their target's, with the fields in order."""
    k, size, name = F.col("p_partkey"), F.col("p_size"), F.col("p_name")
    part = table(spark, sf_dir, "part")
    source = F.struct(
        F.col("p_brand").alias("main_category"), F.array(F.lit("Sub")).alias("sub_categories"), F.when(k % 4 != 0, size % 7).alias("free_count"), F.when(k % 3 == 0, F.concat(F.lit("T"), (k % 5).cast("string"))).alias("push_title"),
        F.lit(None).cast("string").alias("push_content"), F.when(k % 5 != 0, name).alias("synopsis"), F.split(name, " ").alias("tags"), F.when(k % 2 == 0, size).alias("max_chapter"), F.when(k % 7 == 0, " Long").alias("length"),
    )
    target = F.struct(
        F.when(k % 6 == 0, "other").otherwise("SUB ").alias("main_category"), F.array(F.lower("p_brand")).alias("sub_categories"), F.when(k % 8 != 1, size % 7).alias("free_count"), F.concat(F.lit("t"), (k % 4).cast("string")).alias("push_title"),
        F.lit(None).cast("string").alias("push_content"), F.when(k % 11 == 0, F.concat(name, F.lit("!"))).otherwise(F.concat(F.lit("  "), F.upper(name))).alias("synopsis"),
        F.when(k % 9 == 0, F.array(F.lit("none"))).otherwise(F.reverse(F.split(F.upper(name), " "))).alias("tags"), F.when(k % 12 != 0, size).alias("max_chapter"), F.when(k % 14 == 0, "LONG").otherwise("short").alias("length"),
    )
    items = part.select(k.alias("item"), k.alias("title"), source.alias("source"))
    found = reconcile.metadata_reconciled(items, part.where(k % 10 != 9).select(k.alias("title"), target.alias("target")))
    return found.select("item", "outcome", F.array_join(F.transform("differences", lambda d: d["field"]), ",").alias("fields"))


_CONTENTS = """
WITH t AS (SELECT conv_id, turn, max(text) AS text FROM conversations WHERE turn % 4 <> 3 AND conv_id % 5 <> 0 GROUP BY 1, 2 UNION ALL SELECT conv_id, unnest([1, 2, 3]), NULL FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 5 = 0),
f AS (SELECT conv_id, turn, arg_max(text, name) AS text, max(name) AS file FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text || 'x' ELSE text END AS text, 'a' || turn AS name FROM conversations WHERE turn % 5 <> 4
  UNION ALL SELECT conv_id, turn, text, 'b' || turn FROM conversations WHERE turn % 5 <> 4 AND turn % 2 = 0) GROUP BY 1, 2),
c AS (SELECT coalesce(t.conv_id, f.conv_id) AS conv_id, coalesce(t.turn, f.turn) AS turn, CASE WHEN f.conv_id IS NULL THEN 'missing_drive' WHEN t.conv_id IS NULL THEN 'drive_only' WHEN t.text = f.text THEN 'same' ELSE 'different' END AS outcome, file
  FROM t FULL JOIN f ON t.conv_id = f.conv_id AND t.turn = f.turn)
"""


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    files = turns.where("turn % 5 <> 4")
    first = files.select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("text"), F.concat(F.lit("a"), F.col("turn").cast("string")).alias("name"))
    second = files.where("turn % 2 = 0").select("conv_id", "turn", "text", F.concat(F.lit("b"), F.col("turn").cast("string")).alias("name"))
    declared = turns.select("conv_id").distinct().withColumn("declared", F.lit(3))
    return compare.contents(turns.where("turn % 4 <> 3 and conv_id % 5 <> 0"), first.unionByName(second), "conv_id", "turn", "text", "name", declared)


@query(_CONTENTS + "SELECT * FROM c")
def content_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of a target against files; the last file by name counts, and a bare target has those up to its declared maximum."""
    return _contents(spark, sf_dir)


@query(_CONTENTS + "SELECT conv_id, count(*) FILTER (WHERE outcome <> 'drive_only') AS total, count(*) FILTER (WHERE outcome = 'same') AS same, count(*) FILTER (WHERE outcome = 'different') AS different, count(*) FILTER (WHERE outcome = 'missing_drive') AS missing_drive, count(*) FILTER (WHERE outcome = 'drive_only') AS drive_only FROM c GROUP BY 1")
def content_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.content_summary(_contents(spark, sf_dir), "conv_id")


_FOUND = "SELECT p_partkey, p_size FROM part WHERE contains(lower(p_name || ' ' || p_type), 'a') AND p_brand IN (SELECT DISTINCT p_brand FROM part WHERE p_partkey <= 12) AND p_size >= 5"


@query(f"SELECT *, (SELECT count(*) FROM ({_FOUND})) AS total FROM ({_FOUND}) ORDER BY p_size DESC, p_partkey LIMIT 20 OFFSET 20")
def catalogue_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a search by keyword, categories, state and least size."""
    part = table(spark, sf_dir, "part").withColumn("state", F.lit("open"))
    brands = part.where("p_partkey <= 12").select("p_brand")
    found = queues.discovered(part, "A", ("p_name", "p_type"), ("p_brand", brands), ("state", "all"), ("p_size", 5))
    return queues.page(found.select("p_partkey", "p_size"), 2, 20, F.desc("p_size"), F.col("p_partkey"))


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey % 3 = 0 OR l_partkey % 5 = 0), n AS (SELECT l_orderkey, count(*) AS missing FROM s GROUP BY 1),
v AS (SELECT l_orderkey, arg_min('v' || l_suppkey, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey) AS voice FROM lineitem WHERE l_suppkey % 2 = 1 GROUP BY 1)
SELECT s.l_orderkey, s.l_linenumber, missing, voice FROM s JOIN n USING (l_orderkey) LEFT JOIN v USING (l_orderkey) WHERE (SELECT count(*) FROM s) > 10""")
def missing_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments without audio, with their series' first voice, if enough are missing."""
    lines = table(spark, sf_dir, "lineitem")
    k = F.col("l_partkey")
    parts = lines.select("l_orderkey", "l_linenumber", F.when(k % 3 == 0, "").when(k % 5 != 0, "u").alias("url"))
    voices = lines.select("l_orderkey", F.when(F.col("l_suppkey") % 2 == 1, F.concat(F.lit("v"), "l_suppkey")).otherwise("").alias("voice"), (F.col("l_linenumber") * F.lit(1000000000000) + k * 1000000 + F.col("l_suppkey")).alias("position"))
    return segments.missing_audio(parts, voices, "l_orderkey", "l_linenumber", "url", "voice", "position", threshold=10)


@query("""
WITH x AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem), h AS (SELECT k, coalesce(max(n) FILTER (WHERE n <= 2), 0) AS m FROM x GROUP BY k),
f AS (SELECT k, m, n, 'Chapter ' || n AS name FROM x JOIN h USING (k) WHERE n > m UNION ALL SELECT k, m, NULL, 'Extra ' || e FROM h, (VALUES (1), (2)) v(e)),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY coalesce(n, 0), name) AS i FROM f)
SELECT k AS l_orderkey, name, CAST(i + greatest(m, coalesce(max(n - i) OVER (PARTITION BY k ORDER BY i), 0)) AS INTEGER) AS slot FROM r""")
def slot_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordinals under which the files that a target lacks are to be posted; files without a number come first."""
    have = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("ordinal")).distinct()
    numbered = have.withColumn("name", F.concat(F.lit("Chapter "), F.col("ordinal").cast("string")))
    extra = have.select("l_orderkey").distinct().select("l_orderkey", F.lit(None).cast("int").alias("ordinal"), F.explode(F.array(F.lit("Extra 1"), F.lit("Extra 2"))).alias("name"))
    found = segments.wanted_slots(numbered.unionByName(extra), have.where("ordinal <= 2"), "l_orderkey", "ordinal", F.coalesce("ordinal", F.lit(0)), F.col("name"))
    return found.select("l_orderkey", "name", "slot")


@query("""
WITH l AS (SELECT user_id, event_type, arg_max(CAST(floor(value) AS BIGINT), event_id) AS v, arg_max(event_id % 5, event_id) AS i, max(event_id) AS t FROM events GROUP BY 1, 2)
SELECT user_id, count(*) AS items, CAST(sum(greatest(0, coalesce(v, 0) - i)) AS BIGINT) AS net, bool_or(event_type = 'click') AS live, max(t) AS updated FROM l GROUP BY 1""")
def run_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each run has gained since its items' initial values, and whether it is live."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.floor("value").alias("v"), (F.col("event_id") % 5).alias("initial"))
    return telemetry.rollup(events, "user_id", "event_type", "event_id", "v", "initial", F.col("event_type") == "click")


@query("""
SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey
  AND (a.s_acctbal - b.s_acctbal) ** 2 + (a.s_nationkey * 100.0 - b.s_nationkey * 100.0) ** 2 <= (0.5 * greatest(a.s_suppkey % 5 * 100 + 100, b.s_suppkey % 5 * 100 + 100)) ** 2""")
def box_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of boxes whose centres are within half of the larger one's size."""
    boxes = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", (F.col("s_nationkey") * 100.0).alias("y"), (F.col("s_suppkey") % 5 * 100 + 100).alias("size"))
    return compare.near_boxes(boxes, "s_suppkey", "s_acctbal", "y", "size", 500.0)


@query("""
WITH r AS (SELECT p_partkey AS k, p_partkey * 3 AS l, CAST(p_size AS BIGINT) AS t, p_partkey * 3 + p_partkey % 11 AS r, p_size + p_partkey % 17 AS b FROM part)
SELECT x.k AS a, y.k AS b FROM r x JOIN r y ON x.l < x.r AND x.t < x.b AND y.l < y.r AND y.t < y.b AND x.l < y.r AND y.l < x.r AND x.t < y.b AND y.t < x.b""")
def rectangle_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rectangles that share more than an edge, over all parts."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("long")
    boxes = table(spark, sf_dir, "part").select(k.alias("k"), (k * 3).alias("left"), size.alias("top"), (k * 3 + k % 11).alias("right"), (size + k % 17).alias("bottom"))
    return compare.overlapping_boxes(boxes, boxes, "k")


@query("SELECT s AS state, (SELECT count(*) FROM orders WHERE o_orderstatus = s OR s = 'F' AND o_orderstatus = 'P') AS n FROM (VALUES ('F'), ('O'), ('X')) v(s)")
def folded_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by state, one state counted as another."""
    return telemetry.histogram(table(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O", "X"], {"P": "F"})


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey = 7 OR o_custkey = 8 AND o_orderstatus IN ('F', 'P')")
def listed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed and cancelled jobs of two users, one of them by priority."""
    state = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "cancelled").otherwise("running")
    jobs = queues.of_group(table(spark, sf_dir, "orders").withColumn("state", state), "state", "failed")
    mine = queues.among(queues.owned(jobs, "o_custkey", 7), o_orderpriority=["1-URGENT", "2-HIGH"], state=None)
    return mine.unionByName(queues.owned(jobs, "o_custkey", 8)).select("o_orderkey")


@query("""
WITH l AS (SELECT user_id, event_id, event_type, lag(event_type) OVER w AS p, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, max(event_id) FILTER (WHERE r = 1 OR p IS DISTINCT FROM event_type) AS since, max(event_id) - max(event_id) FILTER (WHERE r = 1 OR p IS DISTINCT FROM event_type) AS seconds, max(event_id) - max(event_id) FILTER (WHERE r = 1 OR p IS DISTINCT FROM event_type) > 5 AS idle FROM l GROUP BY 1""")
def unchanged_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Since when each user's kind of event has been the same."""
    return telemetry.silent(table(spark, sf_dir, "events"), "user_id", "event_id", ["event_type"], "event_id", 5)


@query("""
WITH e AS (SELECT user_id, CAST(epoch_us(ts) // 1000000 AS DOUBLE) AS t FROM events), n AS (SELECT *, coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t), 1800000000.0) AS next FROM e),
p AS (SELECT user_id, min(t) AS begun, min(t + 172800.0) FILTER (WHERE next - t > 172800.0) AS idle_at, max(next) AS last FROM n GROUP BY 1), w AS (SELECT *, CASE WHEN greatest(last, 1800000000.0) - begun > 432000.0 THEN begun + 432000.0 END AS whole FROM p)
SELECT user_id, CASE WHEN idle_at IS NULL AND whole IS NULL THEN 'running' WHEN coalesce(idle_at, 1e300) <= coalesce(whole, 1e300) THEN 'idle' ELSE 'too_long' END AS outcome, least(idle_at, whole) AS ended FROM w""")
def run_timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that stood still for two days, or lasted five."""
    events = table(spark, sf_dir, "events").select("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("double").alias("at"))
    return runs.timeouts(events, "user_id", "at", F.lit(1800000000.0), 172800.0, 432000.0)


@query("""
WITH t AS (SELECT *, min(event_id) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id) AS stop FROM events)
SELECT user_id, event_id, event_type, coalesce(event_id = stop, false) AS terminal FROM t WHERE (stop IS NULL OR event_id <= stop) AND event_id > 40""")
def unseen_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines beyond a cursor, up to each run's first final state."""
    return runs.changes(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type", ["purchase"], F.lit(40))


@query("""
WITH r AS (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'crawling' ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'skipped' ELSE 'queued' END END AS status, t.total FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS total FROM lineitem GROUP BY 1) t ON l_orderkey = o_orderkey),
c AS (SELECT *, coalesce(CASE status WHEN 'completed' THEN total WHEN 'crawling' THEN total // 2 ELSE 0 END, 0) AS crawled, status IN ('completed', 'skipped', 'failed') AS done FROM r),
w AS (SELECT o_custkey, count(*) FILTER (WHERE done) AS processed, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) AS stories, sum(crawled) AS crawled, coalesce(avg(crawled) FILTER (WHERE status = 'completed' AND crawled > 0), avg(total) FILTER (WHERE total > 0), 0) AS average,
  coalesce(sum(greatest(0, total - crawled)) FILTER (WHERE NOT done AND total > 0 AND status = 'crawling'), 0) AS active, coalesce(sum(greatest(0, total - crawled)) FILTER (WHERE NOT done AND total > 0 AND status <> 'crawling'), 0) AS queued, count(*) FILTER (WHERE NOT done AND coalesce(total, 0) = 0) AS unknown FROM c GROUP BY 1),
y AS (SELECT *, CASE WHEN processed > 0 THEN greatest(0.05, least(1.0, 1 - (1 - completed / processed) * least(1.0, processed / 500))) ELSE 1.0 END AS ratio, CASE WHEN o_custkey % 3 = 0 THEN 30.0 + o_custkey % 7 END AS rs, CASE WHEN o_custkey % 2 = 0 THEN 2.0 END AS rt FROM w),
z AS (SELECT *, stories - processed AS left_, active + round_even(queued * ratio, 0) + round_even(unknown * average * ratio, 0) AS remaining, CASE WHEN crawled > 0 THEN CAST(crawled AS DOUBLE) END AS lr, CASE WHEN processed > 0 THEN CAST(processed AS DOUBLE) END AS ls FROM y),
v AS (SELECT *, CASE WHEN rs IS NOT NULL AND lr IS NOT NULL THEN 0.65::DOUBLE * rs + 0.35::DOUBLE * lr ELSE coalesce(rs, lr) END AS rate,
  CASE WHEN left_ = 0 THEN 'complete' WHEN rs IS NOT NULL AND lr IS NOT NULL THEN 'blended_chapters' WHEN rs IS NOT NULL THEN 'recent_chapters' WHEN lr IS NOT NULL THEN 'all_time_chapters' WHEN ls IS NOT NULL THEN 'all_time_stories' WHEN rt IS NOT NULL THEN 'recent_stories' ELSE 'insufficient_data' END AS source FROM z)
SELECT o_custkey, source, round(rate, 4) AS segments_per_hour, round(CASE WHEN source = 'complete' THEN 0 WHEN rate > 0 THEN remaining * 3600 / rate ELSE left_ * 3600 / coalesce(ls, rt) END, 3) AS remaining_seconds FROM v""")
def blended_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains per customer with recent rates known for some: rate, time and what the estimate rests on."""
    work = telemetry.workload(_rows(spark, sf_dir), "o_custkey", "status", "total", "crawled")
    k = F.col("o_custkey")
    out = telemetry.estimated(work, F.when(k % 3 == 0, 30.0 + k % 7), F.when(k % 2 == 0, 2.0), F.col("crawled"), F.lit(3600))
    return out.select("o_custkey", "source", F.round("segments_per_hour", 4).alias("segments_per_hour"), F.round("remaining_seconds", 3).alias("remaining_seconds"))


@query("SELECT source, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def missing_segment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label as rows, so that no source's list is gathered."""
    return compare.absent(table(spark, sf_dir, "documents").select("source", "doc_id"), table(spark, sf_dir, "labels"), ["doc_id"])

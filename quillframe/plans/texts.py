"""Queries that clean, compare, cut and read text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.functions import names, prose, text, values
from quillframe.functions import unicode as uni
from quillframe.operators import likeness
from quillframe.operators.compare import suffix_match
from quillframe.plans.registry import query, table


@query("SELECT p_partkey, lower(trim(p_name)) AS a, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS b, trim(regexp_replace(regexp_replace(replace(lower(p_name), '&', ' and '), '[''’`]', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS d FROM part")
def title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys by which titles are matched."""
    return table(spark, sf_dir, "part").select("p_partkey", text.title_key("p_name").alias("a"), text.title_key_collapsed("p_name").alias("b"), text.title_key_words("p_name").alias("d"))


@query()
def title_keys_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that need entities resolved or compatibility forms folded."""
    return table(spark, sf_dir, "part").select("p_partkey", uni.title_key_unescaped(F.col("p_name")).alias("c"), uni.visible("p_name").alias("e"))


@query()
def title_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the title of every twentieth part the three most alike names of all parts."""
    part = table(spark, sf_dir, "part").where("p_name is not null")
    asked = part.where("p_partkey % 20 = 0").select(F.concat("p_name", F.lit(" two")).alias("query")).distinct()
    found = likeness.most_alike(asked, part.select(F.col("p_name").alias("name")).distinct())
    return found.select(F.col("name").alias("p_name"), "query", "score", "r")


@query()
def accepted_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each customer's name with a slip in it, the name of a customer that is like enough to be taken for it."""
    names = table(spark, sf_dir, "customer").where("c_name is not null").select(F.col("c_name").alias("name")).distinct()
    slip = F.concat(F.substring("name", 1, 5), F.substring("name", 7, 100), F.lit("!"))
    return likeness.accepted(names.select(slip.alias("query")).distinct(), names, 0.9)


@query(r"SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(p_name || ': ' || p_type || '?.', '[<>:\"/\\|?*]', '', 'g'), '^[\s.]+|[\s.]+$', '', 'g'), '\s+', '_', 'g'), '_') AS name FROM part")
def filename_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names made of titles."""
    return table(spark, sf_dir, "part").select("p_partkey", text.sanitize_filename(F.concat("p_name", F.lit(": "), "p_type", F.lit("?."))).alias("name"))


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS words FROM documents")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.word_count("text").cast("long").alias("words"))


@query("""
SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '' AND NOT contains(lower(x), 'share this story') AND NOT contains(lower(x), 'all rights reserved')), chr(10) || chr(10))) AS digest FROM documents""")
def clean_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without blank and promotional lines."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.without_promotions("text", ("All rights reserved",))).alias("digest"))


@query("""
SELECT doc_id, len(l) AS n_lines, len(list_distinct(l)) AS n_distinct FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS l FROM documents)""")
def distinct_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document, and how many are left when each stays once, in order."""
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.size(text.distinct_in_order(lines)).cast("long").alias("n_distinct"))


@query(r"""
WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents), w AS (SELECT doc_id, t, len(list_filter(string_split(t, ' '), lambda x: x <> '')) AS n FROM d)
SELECT doc_id, CASE WHEN t = '' THEN true WHEN n > 800 THEN false ELSE n < 12 OR contains(lower(t), 'about the author') OR contains(lower(t), 'follow +') OR contains(lower(t), 'write a review') OR contains(lower(t), 'add to reading list') OR contains(lower(t), 'next chapter') END AS thin FROM w""")
def thin_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is a document too short or marked as something else?"""
    return table(spark, sf_dir, "documents").select("doc_id", text.is_thin("text").alias("thin"))


@query()
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into chunks of about 1,000 characters."""
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.chunks("text", 1000)).alias("pos", "chunk"))
    return chunks.select("doc_id", "pos", F.length("chunk").alias("size"), F.md5("chunk").alias("digest"))


@query()
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of pages: size, share of common words, digest."""
    pages = table(spark, sf_dir, "pages").select("page_id", uni.page_text("html").alias("t"))
    return pages.select("page_id", F.length("t").alias("size"), F.round(prose.prose_share(F.col("t")), 9).alias("prose"), F.md5("t").alias("digest"))


@query()
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages with their text."""
    pages = table(spark, sf_dir, "pages").select("page_id", uni.cards("html").alias("cards"))
    return pages.select("page_id", F.posexplode("cards").alias("pos", "card")).select("page_id", "pos", "card.href", "card.title")


@query("SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS canonical FROM pages")
def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", values.canonical_url("url").alias("canonical"))


@query(r"""
SELECT page_id, regexp_replace(coalesce(nullif(regexp_extract(u, '(?i)/stories/([^/?#]+)', 1), ''), nullif(regexp_extract(u, '(?i)/novel/([^/?#]+)', 1), ''), nullif(regexp_extract(u, '(?i)/story/([^/?#]+)', 1), ''), nullif(regexp_extract(u, '(?i)/book/([^/?#]+)', 1), ''),
  nullif(regexp_extract(u, '(?i)/series/([^/?#]+)', 1), ''), nullif(regexp_extract(u, '(?i)/works/([^/?#]+)', 1), ''), nullif(regexp_extract(u, '(?i)/[^/]+/([^/?#]+)', 1), ''), string_split(u, '/')[-1]), '(?i)-chapter-\d+(?:-\d+)?$', '') AS slug
FROM (SELECT page_id, regexp_replace(url, '/+$', '') AS u FROM pages)""")
def url_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", values.slug("url").alias("slug"))


@query(r"""
WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)) AS host FROM pages), n AS (SELECT DISTINCT regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS name FROM h WHERE page_id % 3 = 0)
SELECT page_id, (SELECT max(name) FROM n WHERE h.host = n.name OR suffix(h.host, '.' || n.name)) AS site FROM h""")
def site_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known site of a page by its host or a parent domain."""
    pages = table(spark, sf_dir, "pages").select("page_id", values.host_suffixes("url").alias("suffixes"))
    known = pages.where("page_id % 3 = 0").select(F.expr("element_at(suffixes, -1)").alias("site")).distinct()
    return suffix_match(pages, "suffixes", known, "site", "page_id").select("page_id", "site")


@query(r"""
SELECT tone, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(m, '\b(429|403|failed|failure|error|exception|blocked)\b') THEN 'error' WHEN regexp_matches(m, '\b(pause|paused|restart|retry|page cap|rate)\b') THEN 'warning'
  WHEN regexp_matches(m, '\b(completed|finished|exported|download|skipped \d+ story)\b') THEN 'success' ELSE 'neutral' END AS tone
  FROM (SELECT lower(event_type || CASE WHEN event_id % 5 = 0 THEN ' retry' WHEN event_id % 7 = 0 THEN ' finished' ELSE '' END) AS m FROM events)) GROUP BY tone""")
def log_tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines by tone."""
    line = F.concat("event_type", F.when(F.col("event_id") % 5 == 0, " retry").when(F.col("event_id") % 7 == 0, " finished").otherwise(""))
    return table(spark, sf_dir, "events").groupBy(values.log_tone(line).alias("tone")).agg(F.count("*").alias("n"))


@query("""
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'queued' WHEN event_id % 4 = 1 THEN 'skipped' WHEN event_id % 4 = 2 THEN 'failed' ELSE 'skipped' END AS status, event_id % 4 = 0 AS recoverable FROM events""")
def error_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state that an error message leads to."""
    message = F.element_at(F.array(*map(F.lit, ["Got HTTP 429", "HTTP 410 Gone", "Something broke", "Paid chapter ahead"])), (F.col("event_id") % 4).cast("int") + 1)
    return table(spark, sf_dir, "events").select("event_id", values.error_status(message).alias("status"), values.is_recoverable(message).alias("recoverable"))


@query("""
SELECT event_id, CASE WHEN s >= 86400 THEN s // 86400 || 'd ' || s % 86400 // 3600 || 'h' WHEN s >= 3600 THEN s // 3600 || 'h ' || s % 3600 // 60 || 'm' WHEN s >= 60 THEN s // 60 || 'm' ELSE s || 's' END AS label FROM (SELECT event_id, event_id * 37 AS s FROM events)""")
def duration_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", values.duration_label((F.col("event_id") * 37).cast("double")).alias("label"))


@query("""
SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'EXTENDED' WHEN 'F' THEN 'DONE' ELSE 'UNKNOWN' END AS prefix, 'Title ' || o_orderkey AS title, CASE WHEN o_custkey % 3 = 0 THEN 'Wattpad' WHEN o_custkey % 3 = 1 THEN 'Goodnovel' END AS platform,
  o_custkey % 3 < 2 AND o_orderstatus <> 'P' AS valid FROM orders""")
def item_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix, title, platform and validity of source items' names."""
    prefix = F.when(F.col("o_orderstatus") == "O", "EXTENDED_x_").when(F.col("o_orderstatus") == "F", "DONE_x_").otherwise("x")
    token = F.when(F.col("o_custkey") % 3 == 0, "wp").when(F.col("o_custkey") % 3 == 1, "GD").otherwise("max")
    joint = F.when(F.col("o_orderstatus") == "P", F.when(F.col("o_custkey") % 3 < 2, F.concat(F.lit("_"), token)).otherwise("")).otherwise(token)
    name = F.concat(prefix, joint, F.lit(" - Title_"), "o_orderkey")
    rows = table(spark, sf_dir, "orders").withColumn("name", name)
    valid = names.upload_format("name")["valid"] & (F.col("o_orderstatus") != "P")
    return rows.select("o_orderkey", names.item_prefix("name").alias("prefix"), names.item_title("name").alias("title"), names.item_platform("name").alias("platform"), valid.alias("valid"))


@query("""
SELECT l_orderkey, l_linenumber, count(*) AS n, CAST(l_linenumber AS INTEGER) AS ordinal, l_linenumber % 2 = 0 AS valid, CASE WHEN l_linenumber % 2 = 0 THEN 'Part ' || l_linenumber ELSE 'Chapter ' || l_linenumber END AS title FROM lineitem GROUP BY 1, 2""")
def segment_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinal, validity and title of segments' file names."""
    name = F.concat(F.lit("Chapter "), "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(" - Part_"), "l_linenumber")).otherwise(""), F.lit(".md"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).withColumn("name", name)
    return rows.select("l_orderkey", "l_linenumber", "n", names.segment_ordinal("name").alias("ordinal"), names.is_segment_name("name").alias("valid"), names.segment_title("name").alias("title"))


@query("SELECT p_partkey, CAST(floor(CAST(CAST(p_partkey / 10.0 AS DECIMAL(18, 1)) AS DOUBLE) * 1000) AS BIGINT) AS reads FROM part")
def compact_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts read back from their compact form."""
    shown = F.concat((F.col("p_partkey") / 10).cast("decimal(18,1)").cast("string"), F.lit("K"))
    return table(spark, sf_dir, "part").select("p_partkey", values.compact_number(shown).alias("reads"))


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CAST(coalesce(nullif(regexp_extract(p_type, '(\\d+)', 1), ''), '0') AS BIGINT), p_type, p_partkey) AS place FROM part")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in order of their first number, then of themselves."""
    from pyspark.sql import Window as W

    order = W.partitionBy("p_brand").orderBy(names.natural_key("p_type"), "p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", F.row_number().over(order).cast("long").alias("place"))


_WORDS = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in prose.PROSE) + "]"


@query(rf"""
WITH p AS (
  SELECT doc_id, [trim(x, E' \t\n\r') FOR x IN list_concat(list_concat(
    CASE WHEN doc_id % 5 = 0 THEN ['CHAPTER ONE HUNDRED', 'Chapter 12: the beginning of it all', 'Add to Library or Vote for it'] ELSE [] END, regexp_split_to_array(text, '\.|\n')),
    CASE WHEN doc_id % 3 = 0 THEN ['Next chapter of the book and the previous one, which was ' || repeat('good ', 50), 'What was said after that is not there'] ELSE [] END)] AS ps,
    doc_id % 11 = 0 AS listing
  FROM documents WHERE text IS NOT NULL
), v AS (
  SELECT doc_id, ps, listing, [CASE
    WHEN length(x) < 10 THEN 'skip'
    WHEN upper(x) = x AND lower(x) <> x AND length(x) < 50 THEN 'skip'
    WHEN regexp_matches(x, '(?i)(^|\s)\d*chapter\s+\d+') THEN 'skip'
    WHEN regexp_matches(lower(x), '{"|".join(prose.LABELS)}') THEN CASE WHEN length(x) < 200 THEN 'skip' ELSE 'end' END
    WHEN contains(lower(x), 'next') AND contains(lower(x), 'previous') THEN 'end'
    WHEN len([w FOR w IN list_distinct(regexp_split_to_array(lower(x), '\s+')) IF w <> '' AND list_contains({_WORDS}, w)]) < 0.03 * len([w FOR w IN list_distinct(regexp_split_to_array(lower(x), '\s+')) IF w <> '']) THEN CASE WHEN length(x) < 200 THEN 'skip' ELSE 'end' END
    ELSE 'keep' END FOR x IN ps] AS vs
  FROM p
), e AS (SELECT doc_id, listing, ps, vs, CASE WHEN list_contains(vs, 'end') THEN list_position(vs, 'end') - 1 ELSE len(ps) END AS n FROM v
), k AS (SELECT doc_id, listing, i, ps[i] AS x FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM e) WHERE vs[i] = 'keep'
), d AS (SELECT doc_id, x, min(i) AS i FROM k WHERE NOT listing GROUP BY doc_id, x
), b AS (SELECT doc_id, count(*) AS n, md5(string_agg(x, chr(10) ORDER BY i)) AS digest FROM d GROUP BY doc_id HAVING count(*) >= 3)
SELECT p.doc_id, CAST(coalesce(b.n, 0) AS INTEGER) AS paragraphs, coalesce(digest, md5('')) AS digest FROM p LEFT JOIN b ON p.doc_id = b.doc_id""")
def prose_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prose of every text between a page's head and its foot, both built around it; every eleventh page is a list of contents."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    when = lambda n, parts: F.when(F.col("doc_id") % n == 0, F.array(*map(F.lit, parts))).otherwise(F.array().cast("array<string>"))
    head = when(5, ["CHAPTER ONE HUNDRED", "Chapter 12: the beginning of it all", "Add to Library or Vote for it"])
    foot = when(3, ["Next chapter of the book and the previous one, which was " + "good " * 50, "What was said after that is not there"])
    paragraphs = F.transform(F.concat(head, F.split("text", r"\.|\n"), foot), lambda x: F.trim(x, F.lit(" \t\n\r")))
    links = F.array_repeat(F.lit("/book/0000123"), F.when(F.col("doc_id") % 11 == 0, 6).otherwise(5))
    found = docs.select("doc_id", prose.prose_body(paragraphs, links).alias("kept"))
    return found.select("doc_id", F.size("kept").alias("paragraphs"), F.md5(F.array_join("kept", "\n")).alias("digest"))

"""Queries over single fields: numbers, times, lists, log lines, errors, markup, names, facts of pages.

The raw texts are built from a key ``k`` by one expression that Spark and the oracle share; the oracles read them
with expressions of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.functions import names, text, values
from quillframe.operators import telemetry
from quillframe.plans.registry import query, table


def _events(spark: SparkSession, sf_dir: str, **raw: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("k"))
    return rows.select("k", *(F.expr(e).alias(n) for n, e in raw.items()))


def _raw(**raw: str) -> str:
    return "WITH r AS (SELECT k, " + ", ".join(f"{e} AS {n}" for n, e in raw.items()) + " FROM (SELECT event_id AS k FROM events)) "


def _case(*texts: str) -> str:
    return f"CASE k % {len(texts)} " + " ".join(f"WHEN {n} THEN {t}" for n, t in enumerate(texts)) + " END"


_NUMBERS = {"s": _case("' ' || k || ' '", "k || '.7'", "'-' || k", "'x' || k", "''", "NULL"), "t": _case("''", "'7'", "'-3'", "NULL")}


@query(_raw(**_NUMBERS) + r"""
, w AS (SELECT *, CASE WHEN regexp_full_match(trim(s), '-?\d+') THEN CAST(s AS INTEGER) ELSE coalesce(CAST(trunc(TRY_CAST(trim(s) AS DOUBLE)) AS INTEGER), 0) END AS whole FROM r)
SELECT k, whole, greatest(0.0, TRY_CAST(nullif(s, '') AS DOUBLE)) + CASE WHEN TRY_CAST(nullif(s, '') AS DOUBLE) IS NULL THEN NULL ELSE 0.0 END AS wait, least(500, greatest(10, whole)) AS held,
  CASE WHEN regexp_full_match(trim(s), '-?\d+') THEN greatest(0, CAST(s AS INTEGER)) WHEN regexp_full_match(t, '-?\d+') THEN greatest(0, CAST(t AS INTEGER)) ELSE 0 END AS counted, coalesce(nullif(s, ''), nullif(t, '')) AS filled FROM w""")
def number_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers, waiting times, bounds and first filled fields of texts that may hold none."""
    rows = _events(spark, sf_dir, **_NUMBERS)
    return rows.select("k", values.as_int("s").alias("whole"), values.retry_after("s").alias("wait"), values.clamp(values.as_int("s"), 10, 500).alias("held"), values.first_count(F.col("s"), F.col("t")).alias("counted"), values.first_filled("s", "t").alias("filled"))


_TIMES = {"s": _case("'2024-01-0' || (1 + k % 9) || ' 03:04:05'", "'2024-1-5 3:4:' || (k % 60)", "'2024-13-05 00:00:00'", "'2024-01-05'", "'at ' || k", "''")}


@query(_raw(**_TIMES) + r"""
SELECT k, strftime(CASE WHEN regexp_full_match(s, '\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}') THEN try_strptime(s, '%Y-%m-%d %H:%M:%S') END, '%Y-%m-%d %H:%M:%S') AS found FROM r""")
def local_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of one strict form; null for any other."""
    return _events(spark, sf_dir, **_TIMES).select("k", F.date_format(values.local_time("s"), "yyyy-MM-dd HH:mm:ss").alias("found"))


_LISTS = {
    "tags": _case("' a' || k || ', b;c |  | d '", "'one'", "''"),
    "titles": _case("'The  First;\"Second\" ; ' || chr(9) || k", "';;'", "'''single'''"),
    "kinds": _case("'red, \"blue\" ,green'", "'red  blue ' || k", "'# head' || chr(10) || 'x, y' || chr(10) || chr(10) || 'z'"),
}


@query(_raw(**_LISTS) + r"""
SELECT k, array_to_string(list_filter(list_transform(regexp_split_to_array(tags, '[,;|]'), lambda x: trim(x)), lambda x: x <> ''), '~') AS tags,
  array_to_string(list_filter(list_transform(string_split(titles, ';'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'), ' "''')), lambda x: x <> ''), '~') AS titles,
  array_to_string(list_filter(list_transform(flatten(list_transform(list_filter(string_split(kinds, chr(10)), lambda l: NOT starts_with(l, '#')), lambda l: CASE WHEN contains(l, ',') THEN string_split(l, ',') ELSE string_split(l, ' ') END)), lambda x: trim(trim(x), '"')), lambda x: x <> ''), '~') AS kinds FROM r""")
def field_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags and titles between delimiters."""
    rows = _events(spark, sf_dir, **_LISTS)
    return rows.select("k", *(F.array_join(c, "~").alias(n) for n, c in (("tags", values.split_tags("tags")), ("titles", values.title_list("titles")), ("kinds", names.tag_list("kinds")))))


_META = {
    "category": _case("'Main Category: Romance' || chr(10) || 'Sub Category: Fantasy'", "'Werewolf' || chr(10) || chr(10) || ' Romance '", "'# head' || chr(10) || 'main category: LGBTQ+' || chr(10) || 'Romance'", "'Billionaire'", "'Sub category: x' || chr(10) || 'Poetry'"),
    "free": _case("' ' || k || ' ' || chr(10) || 'x'", "'none'", "''"),
    "push": _case("'Title: A' || k || chr(10) || 'Content:  b c '", "'content: only'", "'title: x' || chr(10) || 'TITLE: last'"),
    "story": _case("'# Synopsis' || chr(10) || ' line ' || k || chr(10) || chr(10) || 'more' || chr(10) || '# Other' || chr(10) || 'rest'", "'a' || chr(10) || ' b'", "''"),
    "top": _case("'Max ' || k || ' of 90'", "'none'"),
    "size": _case("' Long' || chr(10) || 'x'", "'SHORT'", "'medium'"),
}


@query(_raw(**_META) + r"""
, l AS (SELECT *, list_filter(list_transform(string_split(lower(category), chr(10)), lambda x: trim(x)), lambda x: x <> '' AND x[1] <> '#') AS c, string_split(push, chr(10)) AS p,
  list_transform(string_split(CASE WHEN contains(story, '# Synopsis') THEN split_part(split_part(story, '# Synopsis', 2), '# Other', 1) ELSE story END, chr(10)), lambda x: trim(x)) AS y FROM r),
m AS (SELECT *, trim(split_part(list_filter(c, lambda x: contains(x, 'main category:'))[-1], ':', 2)) AS named, trim(split_part(list_filter(c, lambda x: contains(x, 'sub category:'))[-1], ':', 2)) AS lesser, list_filter(c, lambda x: NOT contains(x, ' category:')) AS plain FROM l),
n AS (SELECT *, coalesce(named, plain[1]) AS main FROM m)
SELECT k, main, coalesce(lesser, CASE WHEN named IS NULL THEN plain[2] ELSE plain[1] END) AS sub,
  CASE regexp_replace(main, '[ \-_+]', '', 'g') WHEN 'fantasy' THEN '154971fe-7da7-41c4-91ee-b2a9613d6fa0' WHEN 'werewolf' THEN '2d2614d9-2b25-4d1f-bb0a-fb333193de19' WHEN 'romance' THEN '17c9779b-7107-4b24-a020-df735e1dd6cb' WHEN 'billionaire' THEN '1550cd02-d20b-4fc3-9dce-6c8c5ccaba11' WHEN 'lgbtq' THEN '8dabb3e8-3e6c-4b20-9b48-cb7bd028cecf' END AS id,
  CASE WHEN regexp_full_match(trim(split_part(free, chr(10), 1)), '\d+') THEN CAST(trim(split_part(free, chr(10), 1)) AS INTEGER) END AS free,
  trim(substr(list_filter(p, lambda x: starts_with(lower(x), 'title:'))[-1], 7)) AS title, trim(substr(list_filter(p, lambda x: starts_with(lower(x), 'content:'))[-1], 9)) AS content,
  nullif(array_to_string(list_filter(y, lambda x: x <> ''), ' '), '') AS story, CAST(nullif(regexp_extract(top, '\d+'), '') AS INTEGER) AS top, CASE lower(trim(split_part(size, chr(10), 1))) WHEN 'long' THEN 'long' WHEN 'short' THEN 'short' END AS size FROM n""")
def metadata_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories, free count, push text, synopsis, greatest segment and length in metadata files."""
    category, push = names.category_names("category"), names.push_message("push")
    return _events(spark, sf_dir, **_META).select(
        "k", category["main"].alias("main"), category["sub"].alias("sub"), names.category_id(category["main"]).alias("id"), names.free_count("free").alias("free"), push["title"].alias("title"), push["content"].alias("content"),
        names.synopsis("story").alias("story"), names.max_segment("top").alias("top"), names.length_kind("size").alias("size"),
    )


_LOG = {
    "s": _case(
        "'12:34:56 [Book ' || k || '/' || (k + 3) || '] Crawled chapter ' || k || ':  A title '", "'Found ' || k || ' chapter links, target=all (' || (k + 1) || ')'", "'INFO: Scrapy ' || k", "'Traceback in ' || k",
        "'Retrying ' || k", "'   '", "'plain ' || k", "'09:00:01   rendered fallback page'", "'Scanning page ' || k", "'crawled 3/' || k", "'Started Inkitt batch'", "'skipped 4 story'", "'HTTP 403 blocked'",
    )
}


@query(_raw(**_LOG) + r"""
, e AS (SELECT *, trim(s) AS t, CASE WHEN trim(s) = '' THEN NULL WHEN regexp_matches(s, '\b(error|exception|failed|traceback|critical)\b', 'i') THEN 'error' WHEN regexp_matches(s, '\b(warning|retry|retrying)\b', 'i') THEN 'warning'
  WHEN starts_with(trim(s), 'INFO: Scrapy') THEN 'noise' WHEN regexp_matches(s, '\[[^\]]+/\d+\]\s+Crawled chapter \d+:\s+') THEN 'segment' WHEN regexp_matches(s, 'found \d+ chapter links.*target=[^(]+\(\d+\)', 'i') THEN 'total' ELSE 'info' END AS kind FROM r)
SELECT k, kind, CASE kind WHEN 'segment' THEN trim(regexp_extract(t, 'Crawled chapter \d+:\s+(.*)', 1)) END AS title, CASE kind WHEN 'segment' THEN CAST(regexp_extract(t, '/(\d+)\]', 1) AS INTEGER) WHEN 'total' THEN CAST(regexp_extract(t, '\((\d+)\)', 1) AS INTEGER) END AS total,
  regexp_extract(s, '^\d{2}:\d{2}:\d{2}') AS "time", regexp_replace(s, '^\d{2}:\d{2}:\d{2}\s+', '') AS message,
  CASE WHEN regexp_matches(lower(s), '\b(429|403|failed|failure|error|exception|blocked)\b') THEN 'error' WHEN contains(s, 'fallback') THEN 'fallback' WHEN contains(s, 'Scanning page') THEN 'discovery' WHEN regexp_matches(s, '\bcrawled \d+/\d') THEN 'progress' WHEN regexp_matches(s, '^skipped \d+ story') THEN 'success' WHEN contains(s, 'Started Inkitt') THEN 'system' ELSE 'neutral' END AS tone FROM e""")
def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind, title, total, time, message and tone of log lines."""
    event, parts = values.log_event("s"), values.log_parts("s")
    return _events(spark, sf_dir, **_LOG).select("k", event["kind"].alias("kind"), event["title"].alias("title"), event["total"].alias("total"), parts["time"].alias("time"), parts["message"].alias("message"), values.log_tone("s").alias("tone"))


_ERRORS = {
    "s": _case("'Got HTTP 429 '", "'HTTP 410 Gone'", "'Paid chapter ' || k", "'Please log in'", "'No readable chapter content'", "'Just a moment...'", "'A Preview-only page'", "'HTTP 503'", "'Page not found'", "'Connection timed out'", "'Something ' || k", "NULL", "'No readable chapter content: Cloudflare'")
}


@query(_raw(**_ERRORS) + r"""
, e AS (SELECT k, coalesce(lower(s), '') AS m FROM r)
SELECT k, CASE WHEN contains(m, 'http 429') THEN 'queued' WHEN contains(m, 'http 410') OR contains(m, 'paid chapter') THEN 'skipped' ELSE 'failed' END AS inkitt,
  CASE WHEN contains(m, 'no readable') THEN 'failed' WHEN contains(m, 'cloudflare') OR contains(m, 'just a moment') THEN 'queued' ELSE 'failed' END AS novelhall,
  CASE WHEN contains(m, 'cloudflare') OR contains(m, 'preview-only') THEN 'needs_session' WHEN contains(m, 'http 429') OR contains(m, 'http 503') THEN 'queued' WHEN contains(m, 'page not found') THEN 'skipped' ELSE 'failed' END AS jobnib,
  regexp_matches(m, '429|502|503|timed out|connection') AS again FROM e""")
def error_states_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states that error messages lead to at each of three sources."""
    rows = _events(spark, sf_dir, **_ERRORS)
    return rows.select("k", *(values.error_status("s", source).alias(source) for source in ("inkitt", "novelhall", "jobnib")), values.is_recoverable("s").alias("again"))


_COOKIES = {"s": _case("'Cookie: a=' || k || '; b = 2 ;a=x=y'", "'sid=' || k", "'nothing'", "' cookie : =v; c='")}


@query(_raw(**_COOKIES) + r"""
, p AS (SELECT k, unnest(string_split(regexp_replace(trim(s), '^cookie\s*:\s*', '', 'i'), ';')) AS p, unnest(range(len(string_split(s, ';')))) AS i FROM r),
n AS (SELECT k, i, trim(split_part(p, '=', 1)) AS name, trim(substr(p, instr(p, '=') + 1)) AS value FROM p WHERE contains(p, '=')), d AS (SELECT k, name, min(i) AS i, arg_max(value, i) AS value FROM n WHERE name <> '' GROUP BY 1, 2)
SELECT k, string_agg(name || '=' || value, '&' ORDER BY i) AS pairs FROM d GROUP BY k""")
def cookie_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of cookie headers that have some, of equal names the last value."""
    rows = _events(spark, sf_dir, **_COOKIES).select("k", values.cookies("s").alias("c")).where(F.size("c") > 0)
    return rows.select("k", F.array_join(F.transform("c", lambda x: F.concat(x["name"], F.lit("="), x["value"])), "&").alias("pairs"))


_LINES = {"s": _case("''", "'Chapter 12'", "'Chapter 12 begins ' || k", "'1234'", "' 1234 chapters'", "'Reviews (5)'", "'Next   Chapter'", "'A line of prose ' || k || ' that is long enough'", "'VOTE'", "'Vote for the one who tells it best, please'", "'12'")}


@query(_raw(**_LINES) + r"""
, l AS (SELECT k, lower(trim(s)) AS t FROM r)
SELECT k, t = '' OR regexp_full_match(t, 'chapter\s+\d+\s*|\d{3,4}') OR (length(t) < 30 AND (regexp_full_match(t, '\d{3,4}\s+chapters?|reviews?\s*\(\d+\)|next\s+chapter|vote') OR regexp_matches(t, '^chapter\s+\d+\s+[a-z]'))) AS garbage FROM l""")
def garbage_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are headings, numbers or labels of the page around."""
    return _events(spark, sf_dir, **_LINES).select("k", text.is_garbage("s").alias("garbage"))


_MARKUP = "' **' || substr(text, 1, 20) || '** and *' || substr(text, 5, 9) || '* x' || chr(13) || chr(10) || chr(13) || chr(10) || ' second   <b>line</b><br/>' || turn || chr(10) || chr(10) || chr(10) || chr(10) || 'third' || chr(9) || chr(92) || 'n' || turn || '</p> '"


@query(rf"""
WITH r AS (SELECT conv_id, turn, {_MARKUP} AS s FROM conversations), b AS (SELECT *, regexp_replace(trim(s), '\r\n?', chr(10), 'g') AS t FROM r),
m AS (SELECT *, regexp_replace(regexp_replace(t, '\*\*(.+?)\*\*', '\1', 'g'), '\*(.+?)\*', '\1', 'g') AS bare, regexp_replace(regexp_replace(t, '<br/>|</p>', chr(10), 'g'), '<[^>]+>', '', 'g') AS shown FROM b)
SELECT conv_id, turn, md5(array_to_string(list_transform(list_filter(list_transform(string_split(regexp_replace(t, '\*(.+?)\*', '<em>\1</em>', 'g'), chr(10) || chr(10)), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> ''), lambda x: '<p>' || replace(x, chr(10), '<br>') || '</p>'), '')) AS html,
  md5(array_to_string(list_filter(list_transform(string_split(bare, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))) AS plain,
  md5(array_to_string(list_filter(list_transform(string_split(shown, chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: x <> ''), chr(10))) AS compared,
  md5(trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(s, '<[^>]+>', ' ', 'g'), chr(10), ' '), chr(13), ''), chr(92) || 'n', ' '), '\\+', ' ', 'g'), ' +', ' ', 'g'))) AS spoken,
  md5(trim(regexp_replace(regexp_replace(s, '[ \t]+', ' ', 'g'), '\n\n\n+', chr(10) || chr(10), 'g'))) AS spaced, md5(trim(regexp_replace(s, '\s+', ' ', 'g'))) AS line FROM m""")
def markup_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments as HTML, as plain and comparable text, for reading aloud, and as one line."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_MARKUP).alias("s"))
    made = {"html": text.segment_html("s"), "plain": text.plain_from_markdown("s"), "compared": text.comparable("s"), "spoken": text.speech_text("s"), "spaced": text.normalize_whitespace("s"), "line": text.clean_line("s")}
    return rows.select("conv_id", "turn", *(F.md5(c).alias(n) for n, c in made.items()))


_NAMES = {
    "cover": _case("' Cover' || k || ' '", "'Cover.PNG'", "'  '", "'a.b/c'"),
    "site": _case("'Site'", "''", "NULL"),
    "state": _case("'Complete'", "' In  Progress '", "'FINISHED'", "'paused'", "NULL"),
    "asset": _case("'done'", "'Error'", "'Queued'"),
    "q": _case("'Rose' || chr(8217) || 's Tale & ' || k", "'plain'", "'a  b'", "'It''s'"),
    "file": _case("'a: b?' || k", "' <> '"),
}


@query(_raw(**_NAMES) + r"""
, v AS (SELECT *, replace(q, chr(8217), '''') AS p FROM r), u AS (SELECT *, list_filter(list_transform([p, regexp_replace(p, '\b([A-Za-z0-9]+)''s\b', '\1', 'g'), replace(p, '''', ''), regexp_replace(replace(p, '&', ' and '), '[^A-Za-z0-9&]+', ' ', 'g')], lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM v)
SELECT k, CASE WHEN trim(cover) = '' THEN '' WHEN regexp_matches(trim(cover), '\.[A-Za-z0-9]+$') THEN lower(trim(cover)) ELSE trim(cover) || '.jpg~' || trim(cover) || '.png' END AS covers, concat_ws('_', nullif(site, ''), 'n' || k, CASE WHEN k % 3 = 0 THEN 'Completed' WHEN k % 3 = 1 THEN 'Ongoing' END) AS output,
  CASE lower(trim(regexp_replace(coalesce(state, ''), '\s+', ' ', 'g'))) WHEN 'complete' THEN 'completed' WHEN 'finished' THEN 'completed' WHEN 'in progress' THEN 'ongoing' ELSE 'unknown' END AS state, CASE lower(asset) WHEN 'done' THEN 'updated' WHEN 'error' THEN 'failed' ELSE lower(asset) END AS asset,
  array_to_string(list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i), '~') AS queries, coalesce(nullif(trim(regexp_replace(file, '[<>:?]', '', 'g')), ''), 'story') AS file FROM u""")
def name_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of covers, outputs and files, states, and ways to write a search."""
    rows = _events(spark, sf_dir, **{n: e.replace("chr(8217)", "'’'") for n, e in _NAMES.items()})
    k = F.col("k") % 3
    return rows.select(
        "k", F.array_join(values.asset_variants("cover"), "~").alias("covers"), values.output_name(F.col("site"), F.concat(F.lit("n"), "k"), F.when(k < 2, k == 0)).alias("output"), values.series_status("state").alias("state"),
        values.asset_status("asset").alias("asset"), F.array_join(text.query_variants("q"), "~").alias("queries"), text.simple_filename("file").alias("file"),
    )


_PAGE = {"s": _case("'About' || chr(10) || 'status ' || chr(10) || '  Ongoing   now' || chr(10) || '4.5 1,200 reviews' || chr(10) || k || '.5K reads'", "'Status' || chr(10) || k || chr(10) || '3 reviews and 12,' || (100 + k % 900) || ' views'", "'Statuses'")}


@query(_raw(**_PAGE) + r"""
, p AS (SELECT *, regexp_replace(s, '\s+', ' ', 'g') AS t FROM r)
SELECT k, trim(regexp_replace(regexp_extract(s, '(?im)^status[ \t]*\n\s*([^\n]+)', 1), '\s+', ' ', 'g')) AS status, CAST(nullif(regexp_extract(t, '(\d+(\.\d+)?) [\d,]+ reviews', 1), '') AS DOUBLE) AS rating, CAST(nullif(replace(regexp_extract(t, '([\d,]+) reviews', 1), ',', ''), '') AS INTEGER) AS reviews,
  CASE k % 3 WHEN 0 THEN CAST(CAST(regexp_extract(t, '([\d.]+)K reads', 1) AS DOUBLE) * 1000 AS BIGINT) WHEN 1 THEN CAST(replace(regexp_extract(t, '([\d,]+) views', 1), ',', '') AS BIGINT) END AS reads FROM p""")
def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled value, rating, reviews and reads of pages' visible text."""
    found = values.page_numbers("s")
    return _events(spark, sf_dir, **_PAGE).select("k", values.label_value(F.col("s"), "Status").alias("status"), found["rating"].alias("rating"), found["reviews"].alias("reviews"), found["reads"].alias("reads"))


@query("""
WITH o AS (SELECT o_custkey, count(*) AS stories, count(*) FILTER (WHERE o_orderstatus = 'F') AS processed, CAST(sum(o_orderkey % 40) AS BIGINT) AS known, CAST(sum(o_orderkey % 20) AS BIGINT) AS crawled FROM orders GROUP BY 1),
t AS (SELECT *, stories - processed AS waiting, greatest(known, CAST(round_even(known + (stories - processed) * CASE WHEN processed > 0 THEN CAST(known AS DOUBLE) / processed ELSE 0 END, 0) AS BIGINT)) AS total FROM o)
SELECT o_custkey, waiting, total, greatest(0, total - crawled) AS remaining, round(CASE WHEN crawled > 0 THEN greatest(0, total - crawled) * 3600 / CAST(crawled AS DOUBLE) END, 3) AS seconds, round((3 * (stories % 4) / 4.0 + 1 * (CASE WHEN processed > 0 THEN 1.0 ELSE 0.0 END)) / 4, 9) AS share FROM t""")
def simple_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains per customer if all orders are like the finished ones, and a weighted share of progress."""
    orders = table(spark, sf_dir, "orders")
    work = orders.groupBy("o_custkey").agg(F.count("*").alias("stories"), F.count_if(F.col("o_orderstatus") == "F").alias("processed"), F.sum(F.col("o_orderkey") % 40).alias("known"), F.sum(F.col("o_orderkey") % 20).alias("crawled"))
    found = telemetry.simple_estimate(F.col("stories"), F.col("processed"), F.col("known"), F.col("crawled"), F.lit(3600))
    parts = F.create_map(F.lit("text"), (F.col("stories") % 4) / 4.0, F.lit("cover"), F.when(F.col("processed") > 0, 1.0))
    share = values.weighted(parts, F.create_map(F.lit("text"), F.lit(3), F.lit("cover"), F.lit(1)))
    return work.select("o_custkey", found["remaining_stories"].alias("waiting"), found["total"].alias("total"), found["remaining"].alias("remaining"), F.round(found["remaining_seconds"], 3).alias("seconds"), F.round(share, 9).alias("share"))

"""Queries over stored files and payloads at rest: catalogues, records, folders, headers, previews, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillframe.functions import text, values
from quillframe.operators import merkle, queues, segments, tables, telemetry
from quillframe.plans.fields import _case, _events, _raw
from quillframe.plans.registry import query, table
from quillframe.sources import files, footers


@query("""
SELECT conv_id, md5(to_json({'id': conv_id, 'chapter_count': count(*), 'chapters': list({'number': turn, 'title': role, 'content': text} ORDER BY turn, role, text)})::VARCHAR) AS digest FROM conversations GROUP BY conv_id""")
def conversation_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of each conversation's turns."""
    found = segments.manifest(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role"), F.col("text"))
    return found.select("conv_id", F.md5("manifest").alias("digest"))


@query("""
WITH d AS (SELECT user_id, event_id % 7 AS slot, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2, 3)
SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 4""")
def recent_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last four lines of each user, equal ones once."""
    lines = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 7).alias("slot"), "event_type", "event_id")
    return telemetry.recent_lines(lines, "user_id", "slot", "event_type", "event_id", 4)


@query("""
SELECT event_id, CASE WHEN k = 0 THEN 'a,b,c' WHEN k = 1 THEN 'c,a' ELSE 'b' END AS kept, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END, event_id) AS INTEGER) AS place FROM (SELECT *, event_id % 3 AS k FROM events)""")
def chosen_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allowed kinds of each event, all where none is given, and its place with the selected ones first."""
    given = F.element_at(F.array(F.array(F.lit("x")), F.array(F.lit("c"), F.lit("z"), F.lit("a"), F.lit("c")), F.array(F.lit("b"))), (F.col("event_id") % 3).cast("int") + 1)
    order = W.partitionBy("user_id").orderBy(*queues.selected_first(F.col("event_type") == "purchase", F.col("event_id")))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(queues.whitelisted(given, ["a", "b", "c"]), ",").alias("kept"), F.row_number().over(order).alias("place"))


_PAYLOADS = {
    "j": _case(
        "'[{\"chapters\":[{\"id\":\"a' || k || '\",\"chapterName\":\"One\",\"index\":1},{\"id\":\"b\",\"chapterName\":\"Two\",\"index\":2}]},{\"chapters\":[{\"id\":\"c\"}]}]'",
        "'[{\"id\":\"x' || k || '\",\"chapterName\":\"N\",\"index\":3}]'", "'{\"records\":[{\"id\":\"r' || k || '\"},{\"id\":\"q\"}]}'", "'{\"list\":[{\"id\":\"l\"}]}'", "'{\"other\":1}'",
    )
}


@query(_raw(**_PAYLOADS) + """
SELECT k, array_to_string(CASE WHEN json_type(j) = 'ARRAY' THEN list_concat(json_extract_string(j, '$[*].chapters[*].id'), json_extract_string(j, '$[*].id'))
  ELSE list_concat(json_extract_string(j, '$.records[*].id'), json_extract_string(j, '$.list[*].id')) END, ',') AS ids FROM r""")
def flat_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of segment records in payloads of several shapes."""
    rows = _events(spark, sf_dir, **_PAYLOADS).select("k", files.flat_records(F.col("j")).alias("records"))
    return rows.select("k", F.array_join(F.transform("records", lambda r: r["id"]), ",").alias("ids"))


_CATALOGUES = {
    "j": _case(
        "'{\"stories\":[{\"id\":\"s' || k || '\",\"title\":\" A  b \",\"url\":\"u\",\"genre\":\"G\"},{\"id\":\"\",\"title\":\"t\",\"url\":\"u\",\"genre\":\"G\"}]}'",
        "'[{\"story_id\":\"l' || k || '\",\"name\":\"N\",\"url\":\"v\",\"category\":\"C\"},{\"id\":\"bad\",\"title\":\"t\"}]'", "'{\"x\":{\"id\":\"m' || k || '\",\"title\":\"T\",\"url\":\"w\",\"category\":\"K\"}}'", "'{\"data\":[]}'",
    )
}


@query(_raw(**_CATALOGUES) + r"""
, e AS (SELECT unnest(CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') WHEN json_exists(j, '$.stories') THEN json_extract(j, '$.stories[*]') WHEN json_exists(j, '$.data') THEN json_extract(j, '$.data[*]') ELSE json_extract(j, '$.*') END) AS x FROM r),
f AS (SELECT coalesce(json_extract_string(x, '$.id'), json_extract_string(x, '$.story_id')) AS id, trim(regexp_replace(coalesce(json_extract_string(x, '$.title'), json_extract_string(x, '$.name')), '\s+', ' ', 'g')) AS title, json_extract_string(x, '$.url') AS url, coalesce(json_extract_string(x, '$.category'), json_extract_string(x, '$.genre')) AS category FROM e)
SELECT * FROM f WHERE id <> '' AND title <> '' AND url <> '' AND category <> ''""")
def catalogue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid rows of catalogue documents, whatever their shape."""
    return files.catalogue_refs(_events(spark, sf_dir, **_CATALOGUES), "j")


@query("SELECT doc_id, md5(array_to_string(list_slice(string_split(text, chr(10)), 1, 5), chr(10))) AS head, len(string_split(text, chr(10))) AS lines FROM documents")
def document_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five lines of each document, and how many it has."""
    seen = files.preview(F.col("text"), 5)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(seen["head"]).alias("head"), seen["lines"].cast("long").alias("lines"))


@query("""
WITH f AS (SELECT '/s/' || l_orderkey || '/part' || l_linenumber AS path, l_linenumber = 4 AS final, l_linenumber % 3 AS modified FROM lineitem),
g AS (SELECT *, regexp_extract(path, '^(.*)/[^/]+$', 1) AS folder, regexp_extract(path, '[^/]+$') AS name FROM f)
SELECT folder, count(*) FILTER (WHERE NOT final) AS chunks, bool_or(final) AS final, split_part(max(modified || '~' || name), '~', 2) AS newest, max(modified) AS modified, CASE WHEN bool_or(final) THEN 'completed' ELSE 'partial' END AS state FROM g GROUP BY 1""")
def folder_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of folders by the files in them."""
    line = F.col("l_linenumber")
    name = F.concat(F.lit("part"), line.cast("string"))
    listed = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("/s/"), F.col("l_orderkey").cast("string"), F.lit("/"), name).alias("path"), name.alias("name"), F.when(line == 4, "combined").otherwise("chapter").alias("role"), (line % 3).alias("modified"))
    return files.folder_states(listed)


@query("""
SELECT p_partkey, md5(concat_ws(chr(10), '# ' || p_name, CASE WHEN p_partkey % 3 > 0 THEN 'Source: u' || p_partkey END, 'Status: ' || lower(p_brand), 'Chapters: ' || p_size, '', p_type)) AS digest FROM part""")
def headed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts under a header; an unknown address has no line."""
    url = F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit("u"), F.col("p_partkey").cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", F.md5(segments.with_header(F.col("p_name"), url, F.lower("p_brand"), F.col("p_size"), F.col("p_type"))).alias("digest"))


@query("""
WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN event_type END AS kind, CASE WHEN event_id % 5 = 0 THEN event_id * 2 END AS twice FROM events)
SELECT user_id, arg_min(kind, event_id) FILTER (WHERE kind IS NOT NULL) AS kind, arg_min(twice, event_id) FILTER (WHERE twice IS NOT NULL) AS twice FROM e GROUP BY 1""")
def first_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user the first value of each field that is known."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("kind"), F.when(F.col("event_id") % 5 == 0, F.col("event_id") * 2).alias("twice"))
    return segments.first_filled(rows, "user_id", "event_id", "kind", "twice")


_TIMES = "SELECT event_id, ts AS started, CASE event_id % 3 WHEN 1 THEN ts + INTERVAL '90' SECOND WHEN 2 THEN ts - INTERVAL '5' SECOND END AS finished, ts + INTERVAL '1' DAY AS now FROM "


@query(f"""
WITH t AS ({_TIMES} events)
SELECT event_id, greatest(0, (epoch_us(coalesce(finished, now)) - epoch_us(started)) // 1000000) AS seconds, CAST(greatest(1, ceil(event_id / 50)) AS BIGINT) AS pages, CASE WHEN event_id > 0 THEN format('{{:,}}', CAST(floor(event_id * 1.5 + 0.5) AS BIGINT)) || ' ch/h' ELSE '-' END AS rate FROM t""")
def run_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of runs of which some are open, pages of lists, and labels of rates."""
    rows = table(spark, sf_dir, "events").selectExpr("event_id", *_TIMES.removeprefix("SELECT event_id, ").removesuffix(" FROM ").split(", "))
    return rows.select("event_id", telemetry.elapsed_seconds(F.col("started"), F.col("finished"), F.col("now")).alias("seconds"), queues.pages(F.col("event_id"), 50).cast("long").alias("pages"), values.rate_label(F.col("event_id") * 1.5).alias("rate"))


@query("SELECT user_id, event_id FROM events WHERE event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3")
def last_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three events of each user, errors left out by their ids."""
    events = table(spark, sf_dir, "events")
    kept = tables.without_ids(events, events.where("event_type = 'error'"), "event_id")
    return tables.last_n(kept, ["user_id"], 3, F.desc("event_id")).select("user_id", "event_id")


@query("""
SELECT n_nationkey, n_name, 'full' AS target FROM nation WHERE n_nationkey < 5 UNION ALL SELECT n_nationkey, n_name, 'empty' FROM nation""")
def imported_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An import fills an empty target and leaves a filled one as it is."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    full = tables.import_if_empty(nation.where("n_nationkey < 5"), nation).withColumn("target", F.lit("full"))
    return full.unionByName(tables.import_if_empty(nation.where("false"), nation).withColumn("target", F.lit("empty")))


_OVERLAY = {"raw": _case("'{\"a\":\"1\",\"b\":\"' || k || '\"}'", "'{\"b\":\"x\",\"d\":\"2\"}'", "'{}'"), "w": _case("'one two three four five'", "'one'", "' two  words '")}


@query(_raw(**_OVERLAY) + r"""
, l AS (SELECT *, list_filter(regexp_split_to_array(w, '\s+'), lambda x: x <> '') AS words FROM r)
SELECT k, json_extract_string(raw, '$.a') AS a, CAST(k * 2 AS VARCHAR) AS b, 'typed' AS c, json_extract_string(raw, '$.d') AS d, coalesce(json_extract_string(raw, '$.a'), '') || '/' || coalesce(json_extract_string(raw, '$.d'), '') AS rest,
  array_to_string(list_slice(words, -2, len(words)), ' ') AS last_two, CASE WHEN len(words) < 2 THEN w ELSE array_to_string(list_slice(words, 1, len(words) // 2), ' ') || '|' || array_to_string(list_slice(words, len(words) // 2 + 1, len(words)), ' ') END AS halves FROM l""")
def overlaid_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw fields under typed ones, a JSON object without a key, the end of a list, and texts in halves."""
    rows = _events(spark, sf_dir, **_OVERLAY)
    out = values.overlaid(F.from_json("raw", "map<string,string>"), {"b": F.col("k") * 2, "c": F.lit("typed")})
    rest = F.from_json(values.without_key(F.col("raw"), "b"), "map<string,string>")
    field = lambda m, n: F.try_element_at(m, F.lit(n))
    slash = F.concat(F.coalesce(field(rest, "a"), F.lit("")), F.lit("/"), F.coalesce(field(rest, "d"), F.lit("")), F.coalesce(field(rest, "b"), F.lit("")))
    return rows.select("k", *(field(out, n).alias(n) for n in "abcd"), slash.alias("rest"), F.array_join(values.tail(text.words(F.col("w")), 2), " ").alias("last_two"), F.array_join(text.halves("w"), "|").alias("halves"))


_ECHOES = {"p": _case("'Chapter 3: Start|The Series|Chapter 3|Body ' || k || '|Chapter 9'", "' |Start |' || k", "'Chapter 3|start'", "'Told at once|Start'")}


@query(_raw(**_ECHOES) + r"""
, u AS (SELECT k, unnest(string_split(p, '|')) AS x, unnest(range(len(string_split(p, '|')))) AS i FROM r), e AS (SELECT *, lower(trim(x)) IN ('', 'chapter 3: start', 'chapter 3', 'start', 'the series') OR (length(x) < 40 AND regexp_matches(lower(trim(x)), '^chapter\s+\d+')) AS echo FROM u),
f AS (SELECT k, min(i) FILTER (WHERE NOT echo) AS begin FROM e GROUP BY 1)
SELECT k, coalesce(string_agg(x, '|' ORDER BY i) FILTER (WHERE i >= begin), '') AS body FROM e JOIN f USING (k) GROUP BY k""")
def unechoed_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments without the leading paragraphs that repeat their headings."""
    kept = text.without_echoes(F.split("p", r"\|"), F.lit("Chapter 3: Start"), F.lit("The  Series"))
    return _events(spark, sf_dir, **_ECHOES).select("k", F.array_join(kept, "|").alias("body"))


@query("SELECT min(l_orderkey) AS least_l_orderkey, max(l_orderkey) AS highest_l_orderkey, min(l_linenumber) AS least_l_linenumber, max(l_linenumber) AS highest_l_linenumber FROM lineitem")
def highest_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least and the highest keys of a table, from the footers of its files."""
    return footers.extremes(spark, f"{sf_dir}/lineitem.parquet", "l_orderkey", "l_linenumber")


@query("""
WITH l AS (SELECT md5(CAST(l_orderkey AS VARCHAR))[1:2] AS node, md5(concat_ws(chr(31), l_linenumber, l_linestatus, l_orderkey, l_partkey, l_returnflag, coalesce(CAST(l_suppkey AS VARCHAR), chr(0)))) AS h FROM lineitem),
q AS (SELECT node, count(*) AS n, sum(('0x' || h[1:8])::BIGINT::HUGEINT) AS a, sum(('0x' || h[9:16])::BIGINT::HUGEINT) AS b, sum(('0x' || h[17:24])::BIGINT::HUGEINT) AS c, sum(('0x' || h[25:32])::BIGINT::HUGEINT) AS d FROM l GROUP BY node),
two AS (SELECT node, n, md5(concat_ws(',', n, a, b, c, d)) AS digest FROM q),
one AS (SELECT node[1:1] AS node, CAST(sum(n) AS BIGINT) AS n, md5(string_agg(digest, ',' ORDER BY node)) AS digest FROM two GROUP BY node[1:1])
SELECT * FROM two UNION ALL SELECT * FROM one UNION ALL SELECT '', CAST(sum(n) AS BIGINT), md5(string_agg(digest, ',' ORDER BY node)) FROM one""")
def table_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of digests over a table's parts, by which copies are compared."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    return merkle.tree(merkle.leaves(lines, ["l_orderkey"]))

"""Reading stored files of series: segments as JSON, JSON lines or Markdown, folders, catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.functions.text import clean_line, strip
from quillframe.functions.values import first_filled
from quillframe.operators.compare import absent
from quillframe.operators.dedup import last_wins

_SEGMENT = "array<struct<number:int,title:string,content:string,url:string>>"


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, text`` of every file below a path."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """``path, number, title, content, url`` of segment files, each a JSON list, an object, or JSON lines.

    A file that is none of these gives no row.
    """
    files = whole_texts(spark, path)
    text = F.trim(F.col("text"))
    as_list = F.when(F.startswith(text, F.lit("[")), text).otherwise(F.concat(F.lit("["), F.array_join(F.filter(F.split(text, r"\r?\n(?=\s*\{)"), lambda x: F.trim(x) != ""), ","), F.lit("]")))
    rows = files.select("path", F.explode(F.from_json(as_list, _SEGMENT)).alias("s")).select("path", "s.*")
    return rows.where("number is not null or content is not null")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """``path, number, title, content`` of Markdown segments: a header line ``...: title``, then the text."""
    files = whole_texts(spark, path)
    head = r"^(?:\S+?_)?chapter[_ ](\d+)(?:\.md)?:[ \t]*([^\n]*)"
    name = F.regexp_extract("path", r"(\d+)[^/\d]*$", 1).try_cast("int")
    number = F.coalesce(F.regexp_extract("text", f"(?i){head}", 1).try_cast("int"), name)
    has = F.rlike("text", F.lit(f"(?i){head}"))
    body = F.when(has, F.regexp_replace("text", f"(?is){head}\\n?", "")).otherwise(F.col("text"))
    return files.select("path", number.alias("number"), F.when(has, F.trim(F.regexp_extract("text", f"(?i){head}", 2))).otherwise("").alias("title"), strip(body).alias("content"))


def listing(spark: SparkSession, path: str, endings: tuple[str, ...] = ("md", "json", "csv")) -> DataFrame:
    """``path, name, size, modified, role, number`` of the files below a path with one of the endings; contents are not read.

    A file whose name holds ``_chapter_`` is a chapter; any other one is a combined text.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    name = F.regexp_extract("path", "([^/]+)$", 1)
    role = F.when(F.contains(name, F.lit("_chapter_")), "chapter").otherwise("combined")
    return files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(list(endings))).select("path", name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), role.alias("role"), F.regexp_extract(name, r"(?i)chapter[_ ]?(\d+)", 1).try_cast("int").alias("number"))


def folder_states(files: DataFrame) -> DataFrame:
    """State of each folder by its files: done if a final file is there, else partial; with the newest file."""
    folder = F.regexp_extract("path", "^(.*)/[^/]+$", 1)
    return files.groupBy(folder.alias("folder")).agg(
        F.count_if(F.col("role") == "chapter").alias("chunks"),
        F.bool_or(F.col("role") == "combined").alias("final"),
        F.max_by("name", F.struct("modified", "name")).alias("newest"),
        F.max("modified").alias("modified"),
    ).withColumn("state", F.when(F.col("final"), "completed").otherwise("partial"))


def preview(text: Column, n: int = 30) -> Column:
    """First ``n`` lines of a text and how many it has."""
    lines = F.split(text, "\n")
    return F.struct(F.array_join(F.slice(lines, 1, n), "\n").alias("head"), F.size(lines).alias("lines"))


def site_catalogue(spark: SparkSession, rows: list[dict[str, str]]) -> DataFrame:
    """A dimension of sites from configuration entries that the caller has loaded (``name, domain``)."""
    return spark.createDataFrame([(r.get("name"), (r.get("domain") or "").lower()) for r in rows], "name string, domain string").where("domain <> ''")


def scan_sites(spark: SparkSession, path: str) -> DataFrame:
    """``site_name, base_url, domains, rate_limit, config_name`` from configuration files (YAML) below a path.

    Plain keys at the left margin are read; domains may be one, a list in brackets, or lines with dashes.  A
    missing name is the file's, a missing rate is 1.
    """
    files = whole_texts(spark, path).select(F.regexp_extract("path", r"([^/]+)\.ya?ml$", 1).alias("config_name"), "text").where("config_name <> ''")
    bare = lambda c: F.btrim(F.btrim(c), F.lit("\"'"))
    value = lambda key: bare(F.regexp_extract("text", rf"(?m)^{key}:[ \t]*([^\r\n#]*)", 1))
    below = F.regexp_extract_all(F.regexp_extract("text", r"(?m)^domains:[ \t]*\r?\n((?:[ \t]*-[^\n]*(?:\n|$))+)", 1), F.lit(r"(?m)-[ \t]*([^\r\n#]*)"), 1)
    domains = F.when(value("domains") == "", below).otherwise(F.split(F.translate(value("domains"), "[]", ""), ","))
    domains = F.filter(F.transform(domains, bare), lambda d: d != "")
    name = F.coalesce(F.nullif(value("site_name"), F.lit("")), F.col("config_name"))
    return files.select(name.alias("site_name"), value("base_url").alias("base_url"), domains.alias("domains"), F.coalesce(value("rate_limit").try_cast("double"), F.lit(1.0)).alias("rate_limit"), "config_name")


_REF = "struct<id:string,story_id:string,title:string,name:string,url:string,genre:string,category:string>"


def catalogue_refs(documents: DataFrame, column: str) -> DataFrame:
    """``id, title, url, category`` from catalogue documents, whose rows may come as a list, under ``stories``,
    ``items`` or ``data``, or as an object by id.  Rows without all four are dropped; of equal ids the last stays."""
    c = F.col(column)
    wrapped = F.from_json(c, f"struct<stories:array<{_REF}>,items:array<{_REF}>,data:array<{_REF}>>")
    listed = F.from_json(c, f"array<{_REF}>")
    keyed = F.map_values(F.map_filter(F.from_json(c, f"map<string,{_REF}>"), lambda k, v: v.isNotNull() & ~k.isin("stories", "items", "data")))
    is_list = F.startswith(F.ltrim(c), F.lit("["))
    rows = F.when(is_list, listed).otherwise(F.coalesce(wrapped["stories"], wrapped["items"], wrapped["data"], keyed))
    refs = documents.select(F.monotonically_increasing_id().alias("doc"), F.posexplode(rows).alias("pos", "r"))
    refs = refs.select("doc", "pos", first_filled("r.id", "r.story_id").alias("id"), clean_line(first_filled("r.title", "r.name")).alias("title"), F.col("r.url").alias("url"), first_filled("r.category", "r.genre").alias("category"))
    good = refs.where("coalesce(id, '') <> '' and coalesce(title, '') <> '' and coalesce(url, '') <> '' and coalesce(category, '') <> ''")
    return last_wins(good, ["id"], F.col("doc"), F.col("pos")).drop("doc", "pos")


def import_catalogue(documents: DataFrame, column: str, exported: DataFrame) -> DataFrame:
    """The refs of catalogue documents that were not exported yet."""
    return absent(catalogue_refs(documents, column), exported, ["id"])


def export_catalogue(refs: DataFrame, path: str) -> None:
    """Writes refs as JSON lines in order of category and lower-case title."""
    refs.orderBy("category", F.lower("title"), "id").write.mode("overwrite").json(path)


def flat_records(c: Column) -> Column:
    """Segment records of a payload: a list of volumes with ``chapters``, a bare list, or ``records``, ``chapters`` or ``list``."""
    item = "struct<id:string,chapterName:string,index:int>"
    volumes = F.from_json(c, f"array<struct<chapters:array<{item}>,id:string,chapterName:string,index:int>>")
    flat = F.flatten(F.transform(volumes, lambda v: F.coalesce(v["chapters"], F.when(v["id"].isNotNull(), F.array(F.struct(v["id"].alias("id"), v["chapterName"].alias("chapterName"), v["index"].alias("index")))), F.from_json(F.lit("[]"), f"array<{item}>"))))
    held = F.from_json(c, f"struct<records:array<{item}>,chapters:array<{item}>,list:array<{item}>>")
    return F.when(F.startswith(F.ltrim(c), F.lit("[")), flat).otherwise(F.coalesce(held["records"], held["chapters"], held["list"], F.from_json(F.lit("[]"), f"array<{item}>")))

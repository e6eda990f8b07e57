"""Queries that write with a sink, read back with a source, and return what came back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.operators.tables import write_replacing, write_segments
from quillframe.plans.registry import query, table
from quillframe.sources import files
from quillframe.sources.store import scratch


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of all conversations as segments of 16 items, numbered apart."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select((F.col("conv_id") % 16).cast("int").alias("item"), (F.col("conv_id") * 1000 + F.col("turn")).cast("int").alias("ordinal"), F.col("role").alias("title"), F.col("text").alias("body"))


_ROWS = "SELECT CAST(conv_id % 16 AS INTEGER) AS item, CAST(conv_id * 1000 + turn AS INTEGER) AS ordinal, role AS title, text AS body FROM conversations"


@query(f"SELECT item, ordinal, title, md5(body) AS digest FROM ({_ROWS})")
def segments_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments written as JSON lines, a file per item, and read back."""
    path = _folder(spark, "json")
    write_segments(_segments(spark, sf_dir), path, "json", "item")
    back = spark.read.schema("ordinal int, title string, body string, item int").json(path)
    return back.select("item", "ordinal", "title", F.md5("body").alias("digest"))


@query(f"SELECT item, ordinal, title, CAST(len([x FOR x IN regexp_split_to_array(body, '\\s+') IF x <> '']) AS INTEGER) AS word_count, md5(body) AS digest FROM ({_ROWS})")
def segments_as_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments written as CSV with their numbers of words, and read back."""
    path = _folder(spark, "csv")
    write_segments(_segments(spark, sf_dir), path, "csv", "item")
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).schema("ordinal int, title string, body string, word_count int, item int").csv(path)
    return back.select("item", "ordinal", "title", "word_count", F.md5("body").alias("digest"))


@query(f"SELECT item, count(*) AS segments, CAST(sum(ordinal) AS BIGINT) AS ordinals, md5(string_agg('Chapter ' || ordinal || ': ' || title, chr(10) ORDER BY ordinal)) AS heads FROM ({_ROWS}) GROUP BY item")
def segments_as_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments written as one Markdown text per item in order, and their header lines read back."""
    path = _folder(spark, "md")
    write_segments(_segments(spark, sf_dir), path, "md", "item")
    texts = files.whole_texts(spark, path).select(F.regexp_extract("path", r"item=(\d+)", 1).cast("int").alias("item"), "text")
    heads = F.regexp_extract_all("text", F.lit(r"(?m)^(Chapter \d+: (?:user|assistant|system))$"), 1)
    rows = texts.select("item", heads.alias("heads"))
    number = lambda h: F.regexp_extract(h, r"(\d+)", 1).cast("long")
    return rows.select("item", F.size("heads").cast("long").alias("segments"), F.aggregate(F.transform("heads", number), F.lit(0).cast("long"), lambda n, x: n + x).alias("ordinals"), F.md5(F.array_join("heads", "\n")).alias("heads"))


@query(f"SELECT item, ordinal AS number, title, md5(body) AS digest FROM ({_ROWS}) WHERE ordinal % 10 < 4")
def segment_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment files of each item, some JSON lists and some JSON lines, read as what they are."""
    path = _folder(spark, "files")
    rows = _segments(spark, sf_dir).where("ordinal % 10 < 4")
    line = F.to_json(F.struct(F.col("ordinal").alias("number"), "title", F.col("body").alias("content")))
    lines = rows.groupBy("item", F.floor(F.col("ordinal") / 100_000).alias("file")).agg(F.collect_list(line).alias("lines"))
    text = F.when(F.col("item") % 2 == 0, F.concat(F.lit("["), F.array_join("lines", ", "), F.lit("]"))).otherwise(F.array_join("lines", "\n"))
    # A file for each group of at most a few hundred segments.
    lines.select("item", "file", text.alias("value")).repartition("item", "file").write.partitionBy("item", "file").text(path)
    back = files.read_segments(spark, path)
    return back.select(F.regexp_extract("path", r"item=(\d+)", 1).cast("int").alias("item"), "number", "title", F.md5("content").alias("digest"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title, 'http://x/' || p_partkey AS url, lower(p_brand) AS category FROM part WHERE p_name <> '' AND p_partkey % 5 <> 0")
def exported_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue written in order and imported again, less what was exported before."""
    path = _folder(spark, "catalogue")
    refs = table(spark, sf_dir, "part").where("p_name <> ''").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.concat(F.lit("http://x/"), "p_partkey").alias("url"), F.lower("p_brand").alias("category"))
    files.export_catalogue(refs, path)
    documents = spark.read.text(path).select(F.concat(F.lit("["), "value", F.lit("]")).alias("text"))
    before = refs.where(F.col("id").cast("int") % 5 == 0).select("id")
    return files.import_catalogue(documents, "text", before)


@query("""
SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN 'again' ELSE 'first' END AS run FROM orders WHERE o_orderstatus <> 'P' OR o_orderkey % 2 = 0
""")
def replaced_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of which one partition was replaced by fewer rows."""
    path = _folder(spark, "partitions")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    write_replacing(orders.withColumn("run", F.lit("first")), path, "o_orderstatus")
    write_replacing(orders.where("o_orderstatus = 'P' and o_orderkey % 2 = 0").withColumn("run", F.lit("again")), path, "o_orderstatus")
    return spark.read.schema("o_orderkey long, run string, o_orderstatus string").parquet(path).select("o_orderkey", "o_orderstatus", "run")

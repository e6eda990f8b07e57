"""Stored files, the paged source and the streaming forms, on small folders."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringStartsWith

from quillframe.operators.tables import write_replacing, write_segments
from quillframe.sources import files, footers, paged
from quillframe.sources.paged import PagedSource
from quillframe.streaming import runs


def test_segment_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"number": 1, "title": "x", "content": "c"}, {"number": 2, "title": "y", "content": "d"}]))
    (tmp_path / "b.jsonl").write_text('{"number": 3, "title": "z"}\n\n{"number": 4, "content": "e"}\n')
    (tmp_path / "c.json").write_text("not json")
    assert sorted(r["number"] for r in files.read_segments(spark, str(tmp_path)).collect()) == [1, 2, 3, 4]


def test_markdown_and_listing(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "s_chapter_7.md").write_text("s_chapter_7.md: The title\nBody one.\n")
    (tmp_path / "s" / "8.md").write_text("Only text")
    (tmp_path / "s" / "s_combined.json").write_text("{}")
    got = {r["number"]: (r["title"], r["content"]) for r in files.read_markdown(spark, str(tmp_path / "s" / "*.md")).collect()}
    assert got == {7: ("The title", "Body one."), 8: ("", "Only text")}
    listed = files.listing(spark, str(tmp_path / "s"))
    assert {(r["name"], r["role"], r["number"]) for r in listed.collect()} == {("s_chapter_7.md", "chapter", 7), ("8.md", "combined", None), ("s_combined.json", "combined", None)}
    assert {r["name"] for r in files.listing(spark, str(tmp_path / "s"), ("json",)).collect()} == {"s_combined.json"}
    row = files.folder_states(listed).first()
    assert (row["chunks"], row["final"], row["state"]) == (1, True, "completed")


def test_site_files(spark, tmp_path):
    (tmp_path / "one.yaml").write_text("site_name: One  # main\nbase_url: 'https://one.example'\ndomains:\n  - one.example\n  - \"www.one.example\"\nrate_limit: 2.5\nother:\n  base_url: no\n")
    (tmp_path / "two.yaml").write_text("base_url: https://two.example\ndomains: [two.example, 'b.example']\n")
    (tmp_path / "three.yaml").write_text("domains: three.example")
    (tmp_path / "x.txt").write_text("site_name: x")
    got = {r["config_name"]: tuple(r)[:4] for r in files.scan_sites(spark, str(tmp_path)).collect()}
    assert got == {
        "one": ("One", "https://one.example", ["one.example", "www.one.example"], 2.5),
        "two": ("two", "https://two.example", ["two.example", "b.example"], 1.0),
        "three": ("three", "", ["three.example"], 1.0),
    }


def test_catalogue_shapes(spark):
    ref = {"id": "1", "title": " A ", "url": "u", "category": "c"}
    docs = spark.createDataFrame([(json.dumps(x),) for x in ([ref], {"stories": [ref | {"id": "2"}]}, {"items": [{"story_id": "3", "name": "B", "url": "u", "genre": "g"}]}, {"4": ref | {"id": "4"}}, [ref | {"title": "late"}], {"data": [{"id": "9"}]})], "j string")
    got = {r["id"]: r["title"] for r in files.catalogue_refs(docs, "j").collect()}
    assert got.keys() == {"1", "2", "3", "4"} and got["3"] == "B"
    left = files.import_catalogue(docs, "j", spark.createDataFrame([("2",)], "id string"))
    assert sorted(r["id"] for r in left.collect()) == ["1", "3", "4"]


def test_flat_records(spark):
    docs = [[{"chapters": [{"id": "a"}, {"id": "b"}]}, {"id": "c"}], {"records": [{"id": "d"}]}, {"list": [{"id": "e"}]}, {}]
    df = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(docs)], "k int, j string")
    got = {r["k"]: [x["id"] for x in r["r"]] for r in df.select("k", files.flat_records(F.col("j")).alias("r")).collect()}
    assert got == {0: ["a", "b", "c"], 1: ["d"], 2: ["e"], 3: []}


def test_preview(spark):
    row = spark.range(1).select(files.preview(F.lit("a\nb\nc"), 2).alias("p")).first()["p"]
    assert tuple(row) == ("a\nb", 3)


def test_paged_source(spark, tmp_path):
    spark.dataSource.register(PagedSource)
    for page, n in ((1, 3), (2, 3), (3, 1), (4, 0)):
        (tmp_path / f"page-{page}.json").write_text(json.dumps([{"id": page * 10 + k, "title": f"t{k}", "category": "c", "updated": "2024"} for k in range(n)]))
    read = spark.read.format("paged").option("path", str(tmp_path))
    assert read.load().count() == 7
    assert read.option("stop", "short").option("size", 3).load().count() == 7
    assert read.option("pagesPerPartition", 1).option("startPage", 2).load().count() == 4
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    pushed = read.option("startPage", 1).option("pushdown", "true")
    assert pushed.load().where("category = 'c' and id > 20").count() == 3
    assert pushed.load().where("category = 'z'").count() == 0
    stream = spark.readStream.format("paged").option("path", str(tmp_path)).load()
    query = stream.writeStream.format("memory").queryName("pages_seen").option("checkpointLocation", str(tmp_path / "check")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("pages_seen").count() == 7


@pytest.mark.parametrize("step", [1, 2, 16])
def test_paged_source_stops_for_all_ranges(spark, tmp_path, step):
    """The second page ends the reading, however pages are dealt out."""
    spark.dataSource.register(PagedSource)
    for page, n in ((1, 2), (2, 0), (3, 2), (4, 2)):
        (tmp_path / f"page-{page}.json").write_text(json.dumps([{"id": page * 10 + k} for k in range(n)]))
    read = spark.read.format("paged").option("path", str(tmp_path)).option("pagesPerPartition", step)
    assert read.load().count() == 2
    (tmp_path / "page-2.json").write_text(json.dumps([{"id": 20}]))
    assert read.load().count() == 7 and read.option("stop", "short").option("size", 2).load().count() == 3
    assert read.option("startPage", 9).load().count() == 0


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "T", "one two"), ("b", 2, "U", 'say "x", y')], "series string, ordinal int, title string, body string")
    for form in ("json", "csv", "md"):
        write_segments(df, str(tmp_path / form), form, "series")
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    got = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert {(r["body"], r["word_count"]) for r in got.collect()} == {("one two", "2"), ('say "x", y', "3")}
    many = spark.createDataFrame([(f"s{k % 3}", k, "T", f"text {k}") for k in range(60)], "series string, ordinal int, title string, body string").repartition(8)
    write_segments(many, str(tmp_path / "many"), "md", "series")
    for k in range(3):
        (one,) = (tmp_path / "many" / f"series=s{k}").glob("part-*")
        assert [int(x.split()[1][:-1]) for x in one.read_text().splitlines() if x.startswith("Chapter")] == list(range(k, 60, 3))
    with pytest.raises(ValueError):
        write_segments(df, str(tmp_path / "x"), "xml", "series")
    write_replacing(df, str(tmp_path / "t"), "series")
    write_replacing(df.where("series = 'a'").withColumn("title", F.lit("new")), str(tmp_path / "t"), "series")
    assert {(r["series"], r["title"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("a", "new"), ("b", "U")}


@pytest.fixture
def events(spark, tmp_path):
    """A stream of two files of events: (run, at, state, line)."""
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    schema = "run string, at timestamp_ntz, state string, line string"
    path = str(tmp_path / "events")
    parts = [
        [("a", t(0), "running", "[s/5] Crawled chapter 1: X"), ("a", t(1), "running", "Traceback"), ("b", t(2), "running", "hello")],
        [("a", t(3), "completed", "[s/5] Crawled chapter 2: Y"), ("a", t(3), "completed", "[s/5] Crawled chapter 2: Y"), ("c", t(600), "running", "x")],
        [("c", t(900), "running", "y")],
    ]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    return stream


def finished(spark, df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def test_progress_stream(spark, events):
    got = {r["run"]: (r["segments"], r["errors"], r["total"]) for r in finished(spark, runs.progress(events, "run", "line"), "progress", "complete").collect()}
    assert got == {"a": (3, 1, 5), "b": (0, 0, None), "c": (0, 0, None)}


def test_distinct_lines_stream(spark, events):
    assert finished(spark, runs.distinct_lines(events, "at", "line"), "lines").count() == 6


def test_limited_stream(spark, events):
    timed = events.withColumn("sec", F.unix_seconds(F.col("at").cast("timestamp")).cast("double"))
    got = finished(spark, runs.limited(timed, "run", "sec", 2, 600.0), "limits")
    assert got.where("run = 'a' and accepted").count() == 2 and got.where("run = 'a' and not accepted").count() == 2


def test_terminal_stream(spark, events):
    got = {(r["run"], r["outcome"]) for r in finished(spark, runs.terminal(events, "run", "at", "state", ["completed"], "30 minutes"), "ends").collect()}
    assert ("a", "completed") in got and ("b", "timed_out") in got


def test_windows_and_spells_stream(spark, events):
    assert finished(spark, runs.windowed_counts(events, "at", "state", "1 hour", "1 minute"), "windows").where("state = 'running'").agg(F.sum("n")).first()[0] >= 3
    assert finished(spark, runs.spells(events, "run", "at", "20 minutes", "1 minute"), "spells").where("run = 'a'").first()["n"] == 4


def test_checkpoints_and_sink(spark, tmp_path):
    pages = spark.createDataFrame([("x", 1, False), ("x", 3, True), ("y", 2, False)], "c string, p int, f boolean")
    assert sorted(tuple(r) for r in runs.discovery(pages, "c", "p", F.col("f")).collect()) == [("x", 3, True), ("y", 2, False)]
    assert runs.resumed(pages, spark.createDataFrame([("x",)], "c string"), "c").count() == 1
    sink = runs.upsert_sink(str(tmp_path / "out"), ["c"], "p")
    sink(pages, 0)
    sink(pages, 0)
    assert runs.latest_image(spark, str(tmp_path / "out")).count() == 2
    # Over all batches each key has one row, the latest; a replay changes nothing.
    more = spark.createDataFrame([("x", 2, False), ("y", 5, True), ("z", 1, False)], "c string, p int, f boolean")
    for number in (1, 1):
        sink(more, number)
        assert sorted(tuple(r) for r in runs.latest_image(spark, str(tmp_path / "out")).select("c", "p").collect()) == [("x", 3), ("y", 5), ("z", 1)]


def pages_of(folder, n, size=5):
    """Pages by descending time, ids rising within; every seventh record lacks a category."""
    folder.mkdir()
    for p in range(1, n + 1):
        rows = [{"id": 100 * p + k, "title": f"{'abc'[k % 3]} title {p}", "category": None if (p + k) % 7 == 0 else f"c{p % 4}", "updated": f"2024-{13 - p:02d}-{k + 1:02d}"} for k in range(size)]
        (folder / f"page-{p}.json").write_text(json.dumps(rows))
    return str(folder)


def test_pages_are_skipped(spark, tmp_path):
    """Which pages are opened for which filters, and that the rows are those that Spark finds without any pushing."""
    folder = pages_of(tmp_path / "p", 12)
    paged.index_pages(spark, folder)
    wanted = [
        ([EqualTo(("id",), 503)], [5]),
        ([In(("id",), (503, 1101, None))], [5, 11]),
        ([GreaterThanOrEqual(("updated",), "2024-11-03"), LessThan(("updated",), "2024-12-02")], [1, 2]),
        ([StringStartsWith(("updated",), "2024-05")], [8]),
        ([EqualTo(("category",), "c2"), LessThanOrEqual(("page",), 7)], [2, 6]),
        ([IsNull(("category",)), GreaterThan(("id",), 1000)], [10, 11, 12]),
        ([IsNotNull(("category",)), EqualTo(("id",), 7)], []),
    ]
    everything = spark.read.format("paged").option("path", folder).load()
    for filters, pages in wanted:
        reader = paged.FilteringReader({"path": folder})
        assert list(reader.pushFilters(filters)) == []
        parts = reader.partitions()
        assert [k for p in parts for k in p.pages] == pages
        got = sorted(r for p in parts for r in reader.read(p))
        kept = [tuple(r) for r in everything.collect() if all(paged.condition(f).holds(r[f.attribute[0]]) for f in filters)]
        assert got == sorted(kept, key=lambda r: r[:2])
    # A filter on a part of a value is left to Spark; a page that has changed is read whatever the index says.
    reader = paged.FilteringReader({"path": folder})
    assert len(list(reader.pushFilters([StringContains(("title",), "x"), Not(EqualTo(("id",), 1))]))) == 2
    (tmp_path / "p" / "page-9.json").write_text(json.dumps([{"id": 503, "title": "moved", "category": "c0", "updated": "2024-01-01"}]))
    list(reader.pushFilters([EqualTo(("id",), 503)]))
    assert [k for p in reader.partitions() for k in p.pages] == [5, 9]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("paged").option("path", folder).option("pushdown", "true").load()
        assert sorted(r["page"] for r in df.where("id in (503, 1101) and title like '%m%'").collect()) == [9]
        assert df.where("updated >= '2024-11-03' and category is null").count() == everything.where("updated >= '2024-11-03' and category is null").count()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_the_highest_key(spark, tmp_path):
    for n in [0, 1, 2, 3, 7, 8, 9, 100, 1023, 1024, 99_999]:
        asked = []
        assert paged.highest(lambda k, n=n, asked=asked: asked.append(k) or k <= n) == n
        assert len(asked) <= 2 * max(n, 1).bit_length() + 2
    assert paged.highest_page(pages_of(tmp_path / "p", 11)) == 11
    path = f"{tmp_path}/t"
    spark.range(5, 1000, 1, 4).selectExpr("id", "cast(id as int) % 7 as seven").write.parquet(path)
    plan = footers._from_footers(spark, path, "id", "seven")._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [MIN(id), MAX(id), MIN(seven), MAX(seven)]" in plan
    assert footers.extremes(spark, path, "id", "seven").first()[:] == (5, 999, 0, 6)

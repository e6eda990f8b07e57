"""Operators on small literal rows, with nulls, ties and empty tables."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillframe.operators import compare, dedup, limits, queues, reconcile, segments, tables, telemetry


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_conflict_policies(spark):
    df = spark.createDataFrame([(1, "failed", "u", 1.0), (2, "completed", "u", None), (3, "completed", "u", 5.0), (4, "odd", None, 2.0)], "i int, state string, url string, score double")
    df = df.withColumn("key", dedup.key_or_position("url", "i"))
    assert rows(dedup.first_wins(df, ["key"], F.col("i")), "key", "i") == [("index:4", 4), ("u", 1)]
    assert rows(dedup.last_wins(df, ["key"], F.col("i")), "key", "i") == [("index:4", 4), ("u", 3)]
    assert rows(dedup.rank_wins(df, ["key"], "state", ["completed", "failed"], F.col("i")), "key", "i") == [("index:4", 4), ("u", 2)]
    assert rows(dedup.best_score(df, ["key"], "score", F.col("i")), "key", "i") == [("index:4", 4), ("u", 3)]
    assert rows(dedup.unless_placeholder(df, ["key"], F.col("state") == "failed", F.col("i")), "key", "i") == [("index:4", 4), ("u", 2)]
    assert dedup.first_wins(df.limit(0), ["key"], F.col("i")).count() == 0


def test_compared(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, l string")
    right = spark.createDataFrame([(1, "a"), (2, "x"), (3, None), (4, "y")], "k int, r string")
    assert rows(compare.compared(left, right, ["k"], F.col("l") == F.col("r")), "k", "outcome") == [(1, "same"), (2, "different"), (3, "different"), (4, "right_only")]
    assert rows(compare.absent_either_way(left, right, ["k"]), "k", "side") == [(4, "right")]


def test_near_and_overlapping_against_all_pairs(spark):
    rng = random.Random(3)
    points = [(k, rng.uniform(-9, 9), rng.uniform(-9, 9)) for k in range(80)]
    df = spark.createDataFrame(points, "k int, x double, y double")
    want = sorted((a[0], b[0]) for a in points for b in points if a[0] < b[0] and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 4)
    assert rows(compare.near(df, "k", "x", "y", 2.0), "a", "b") == want
    ranges = [(k, k * 3 % 40, k * 3 % 40 + k % 9) for k in range(60)]
    df = spark.createDataFrame(ranges, "k int, low long, high long")
    want = sorted((a[0], b[0]) for a in ranges for b in ranges if a[1] <= b[2] and b[1] <= a[2])
    assert rows(compare.overlapping(df, df, "low", "high", 5), "a_k", "b_k") == want


def test_overlapping_in_crowded_cells_is_spread(spark, monkeypatch):
    ranges = [(k, "x" if k % 4 else None, k % 3, k % 3 + k % 7 - 1) for k in range(600)] + [(1, "x", 1, 2)] * 9 + [(2, None, None, 4), (3, None, 4, None)]
    df = spark.createDataFrame(ranges, "k int, t string, low int, high int").repartition(3)
    kept = [r for r in ranges if None not in r[2:] and r[2] <= r[3]]
    want = sorted(repr((*a, *b)) for a in kept for b in kept if a[2] <= b[3] and b[2] <= a[3])
    for chunk, block in ((1 << 14, 4096), (50, 40)):
        monkeypatch.setattr(compare, "CHUNK", chunk)
        monkeypatch.setattr(compare, "BLOCK", block)
        found = compare.overlapping(df, df, "low", "high", 8)
        assert found.columns == [f"{s}_{c}" for s in ("a", "b") for c in ("k", "t", "low", "high")]
        assert sorted(repr(tuple(r)) for r in found.collect()) == want
    sizes = [r["n"] for r in found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 1 and max(sizes) < 0.8 * len(want)


def test_ordinals(spark):
    df = spark.createDataFrame([("a", 1), ("a", 4), ("a", 4), ("b", None), ("c", 2)], "g string, n int")
    got = rows(segments.ordinal_summary(df, "g", "n"), "g", "first", "segments", "repeated", "missing")
    assert got == [("a", 1, 3, [4], [2, 3]), ("c", 2, 1, [], [])]
    row = spark.range(1).select(segments.free_slots(F.array(F.lit(1), F.lit(3)), F.lit(3)).alias("s"), segments.free_slots(F.array(F.lit(1)), F.lit(0)).alias("z")).first()
    assert row["s"] == [4, 5, 6] and row["z"] == []


def test_slots_of_new_segments(spark):
    """A file's own number counts, files without one go on after all so far, and taken numbers are skipped."""
    cases = [([5, 6], [None, None], [7, 8]), ([], [None, 1, 1, 3], [1, 2, 3, 4]), (None, [4, None], [4, 5]), ([1, 2], [3, 3, None, 9, None], [3, 4, 5, 9, 10]), ([1], [], [])]
    df = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], "k int, have array<int>, want array<int>")
    assert rows(df, "k", segments.slots(F.col("have"), F.col("want")).alias("s")) == [(k, c) for k, (*_, c) in enumerate(cases)]


def test_names_of_helpers_may_be_columns(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), (None, 1, 30)], "k string, _n int, _same int")
    assert rows(tables.last_n(df, ["k"], 1, F.desc("_n")).where("k is not null"), "k", "_n", "_same") == [("a", 2, 20)]
    assert rows(tables.changes_only(df.where("k = 'a'"), ["k"], "_n", ["_same"]), "_n", "_same") == [(1, 10), (2, 20)]
    clash = df.select("k", F.col("_n").alias("_count"), F.col("_same").alias("_coarse"))
    assert rows(tables.numbered(clash, F.col("_coarse")), "position", "_count", "_coarse") == [(1, 1, 10), (2, 2, 20), (3, 1, 30)]
    assert rows(tables.capped(df, "k", ["a"], 2, F.col("_same")).where("k = 'a'"), "_n") == [(2,)]
    both = df.select("k", F.col("_n").alias("_IN_LEFT"))
    assert compare.compared(both, df.select("k", "_same"), ["k"], F.lit(True)).columns == ["k", "_IN_LEFT", "_same", "outcome"]
    with pytest.raises(ValueError):
        queues.page(df.withColumn("Total", F.lit(1)), 1, 5, F.col("k"))
    assert queues.page(df.withColumn("total", F.lit(1)), 1, 5, F.col("_n"), name="all").columns[-1] == "all"


def test_whitelist_and_order(spark):
    df = spark.createDataFrame([(1, ["b", "x", "a", "b"], True), (2, ["x"], None), (3, None, False)], "i int, c array<string>, s boolean")
    assert rows(df, "i", queues.whitelisted(F.col("c"), ["a", "b"]).alias("w")) == [(1, ["b", "a"]), (2, ["a", "b"]), (3, ["a", "b"])]
    assert [r["i"] for r in df.orderBy(*queues.selected_first(F.col("s"), F.desc("i"))).collect()] == [1, 3, 2]


def test_boxes_against_all_pairs(spark):
    rng = random.Random(9)
    boxes = [(k, x := rng.randrange(-20, 20), y := rng.randrange(-20, 20), x + rng.randrange(0, 9), y + rng.randrange(0, 9)) for k in range(50)]
    df = spark.createDataFrame(boxes, "k int, left int, top int, right int, bottom int")
    full = [b for b in boxes if b[1] < b[3] and b[2] < b[4]]
    want = sorted((a[0], b[0]) for a in full for b in full if a[1] < b[3] and b[1] < a[3] and a[2] < b[4] and b[2] < a[4])
    assert rows(compare.overlapping_boxes(df, df, "k"), "a", "b") == want


def test_signature_of_an_archive(spark):
    df = spark.range(20)
    digest = tables.fingerprint(df).first()["digest"]
    assert tables.is_current(df, digest).first()["current"] and not tables.is_current(df.where("id > 3"), digest).first()["current"]
    assert tables.is_current(df, None).first()["current"] is False


def test_capped_keeps_active_rows(spark):
    df = spark.createDataFrame([(1, "done", 1), (2, "done", 2), (3, "run", 0), (4, "done", 2), (5, None, 0)], "i int, s string, t int")
    assert rows(tables.capped(df, "s", ["done"], 3, F.col("t"), F.col("i")), "i") == [(3,), (4,), (5,)]
    assert rows(tables.capped(df, "s", ["done"], 99, F.col("t"), F.col("i")), "i") == [(1,), (2,), (3,), (4,), (5,)]


def test_numbered_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 5), (4, 1)], "i int, t int")
    assert rows(tables.numbered(df, F.col("t"), F.col("i")), "position", "i") == [(1, 1), (2, 4), (3, 2), (4, 3)]


def test_upsert_and_feed(spark):
    base = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k int, v string, created int")
    delta = spark.createDataFrame([(2, "c", 99), (2, "d", 98), (3, None, 30)], "k int, v string, created int")
    out = tables.upserted(base, delta, ["k"], F.col("created"), keep_first=("created",))
    assert rows(out, "k", "v", "created") == [(1, "a", 10), (2, "c", 20), (3, None, 30)]
    assert rows(tables.change_feed(base, out, ["k"]), "k", "change") == [(2, "update"), (3, "insert")]


def test_fingerprint_ignores_order(spark):
    df = spark.range(500).withColumn("x", F.col("id") % 7)
    a, b = (tables.fingerprint(d).first() for d in (df, df.repartition(7).orderBy(F.desc("id"))))
    assert a == b and a["n"] == 500 and tables.fingerprint(df.limit(0)).first()["n"] == 0


def test_claim_and_priority(spark):
    df = spark.createDataFrame([(1, "late", 1, None), (2, "x", 2, None), (3, "x", 2, 0), (4, "blocked", 0, 0)], "i int, kind string, created int, idx int")
    assert [r["i"] for r in queues.claim(df, "kind", "created", "idx", "i", "late", ("blocked",), 3).collect()] == [3, 2, 1]
    df = spark.createDataFrame([(1, 0, "a"), (2, 2, "b"), (3, 1, "a"), (4, 0, "z")], "i int, retry int, c string")
    assert [r["i"] for r in df.orderBy(*queues.prioritised("retry", "c", ["b", "a"], "i")).collect()] == [2, 3, 1, 4]
    assert queues.reordered(["c", "x", "a"], ["a", "b", "c"]) == ["c", "a", "b"]


def test_upload_rules(spark):
    items = spark.createDataFrame([(1, "DONE", "t", True), (2, "DONE", "t", True), (3, "ING", "u", True), (4, "DONE", "v", False), (5, "DONE", "w", True), (6, "DONE", "x", True), (7, "DONE", "y", True), (8, "DONE", "z", True)], "item int, prefix string, title string, valid_name boolean")
    files = spark.createDataFrame([(5, 1, True), (5, 1, True), (6, 2, True), (7, 1, True), (7, 3, True)], "item int, ordinal int, valid boolean")
    out = reconcile.upload_eligibility(items, spark.createDataFrame([("q",)], "title string"), reconcile.segment_facts(files, "item", "ordinal", "valid"))
    assert rows(out, "item", "outcome", "missing") == [
        (1, "invalid_title", None), (2, "invalid_title", None), (3, "not_ready", None), (4, "invalid_source", None),
        (5, "invalid_duplicate", None), (6, "invalid_first", None), (7, "uploadable", [2]), (8, "uploadable", []),
    ]


def test_update_rules(spark):
    items = spark.createDataFrame([(1, "EXTENDED", "a"), (2, "DONE", "a"), (3, "DONE", "b"), (4, "EXTENDED", "c"), (5, "EXTENDED", "d"), (6, "EXTENDED", "e")], "item int, prefix string, title string")
    targets = spark.createDataFrame([("a", 2), ("b", 1), ("d", 1), ("e", 0)], "title string, true_max int")
    files = spark.createDataFrame([(1, 3, True), (1, 4, True), (5, 2, True), (5, 4, True), (6, 1, True)], "item int, ordinal int, valid boolean")
    facts = reconcile.segment_facts(files, "item", "ordinal", "valid")
    marked = spark.createDataFrame([(6, 1)], "item int, ordinal int")
    got = rows(reconcile.update_eligibility(items, targets, facts, marked), "item", "outcome", "new_segments")
    assert got == [(1, "updatable", 2), (3, "wrong_prefix", 0), (4, "no_server_match", 0), (5, "non_sequential", 0), (6, "invalid_rewritten", 0)]


def test_estimate(spark):
    """The case of one finished and two queued series in a run of ten minutes."""
    df = spark.createDataFrame([("r", "completed", 10, 10), ("r", "queued", 20, 5), ("r", "queued", 30, 0)], "run string, status string, total int, crawled int")
    none = F.lit(None).cast("double")
    row = telemetry.estimated(telemetry.workload(df, "run", "status", "total", "crawled"), none, none, F.lit(15), F.lit(600)).first()
    assert (row["crawled"], row["remaining_stories"], row["remaining_segments"], row["segments_per_hour"], row["remaining_seconds"], row["source"]) == (15, 2, 45, 90.0, 1800.0, "all_time_chapters")


def test_recent_rates(spark):
    samples = spark.createDataFrame([("a", 0, 0, 0), ("a", 100, 50, 1), ("b", 0, 0, 0), ("c", 0, 0, 0), ("c", 20, 9, 9)], "k string, at int, c int, s int")
    got = {r["k"]: r for r in telemetry.recent_rates(samples, "k", "at", "c", "s", F.lit(100)).collect()}
    assert got["a"]["segments_per_hour"] == 1800.0 and got["a"]["stories_per_hour"] is None
    assert got["b"]["window_seconds"] is None and got["c"]["segments_per_hour"] is None and got["c"]["window_seconds"] == 20


def test_breaker_and_spells(spark):
    events = spark.createDataFrame([("a", k, e) for k, e in enumerate(["block", "block", "fail", "block", "ok", "block"])], "k string, n int, e string")
    assert rows(telemetry.breaker(events, "k", "n", F.col("e") == "block", F.col("e") == "ok"), "stretch", "blocks", "opens_at") == [(0, 3, 3), (1, 1, None)]
    times = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, h)) for h in (0, 1, 9)], "k string, t timestamp_ntz")
    assert rows(telemetry.idle_islands(times, "k", "t", 7200), "spell", "n") == [(1, 2), (2, 1)]


def test_limiter_and_pacing(spark):
    events = spark.createDataFrame([("a", float(t)) for t in (0, 1, 2, 60, 61)] + [("b", 0.0)], "k string, t double")
    got = rows(limits.limited(events, "k", "t", 2, 60.0), "k", "t", "accepted", "retry_after")
    assert got == [("a", 0.0, True, 0), ("a", 1.0, True, 0), ("a", 2.0, False, 58), ("a", 60.0, True, 0), ("a", 61.0, True, 0), ("b", 0.0, True, 0)]
    # Null is one key, and a time that is missing is rejected.
    odd = spark.createDataFrame([(None, 0.0), (None, 1.0), (None, 2.0), ("a", None)], "k string, t double")
    assert sorted((r["k"] or "", r["t"] or 0.0, r["accepted"]) for r in limits.limited(odd, "k", "t", 1, 60.0).collect()) == [("", 0.0, True), ("", 1.0, False), ("", 2.0, False), ("a", 0.0, False)]
    assert limits.limited(odd.limit(0), "k", "t").count() == 0
    steps = spark.createDataFrame([("a", k, r, h) for k, (r, h) in enumerate([(True, None), (True, 7.0), (False, None), (False, None)])], "k string, n int, r boolean, h double")
    assert rows(limits.paced(steps, "k", "n", "r", "h", recover=2), "n", "interval", "cooldown") == [(0, 1.5, 60.0), (1, 2.0, 7.0), (2, 2.0, 0.0), (3, 1.5, 0.0)]


def test_whole_tables_are_compared(spark):
    from quillframe.plans import catalog

    sf = "/root/testdata/sf0.001"
    parts = [(r["p_partkey"], r["p_size"]) for r in spark.read.parquet(f"{sf}/part.parquet").collect()]
    got = sorted((r["a_k"], r["b_k"]) for r in catalog.QUERIES["range_overlap_whole"](spark, sf).collect())
    assert got == sorted((k, m) for k, s in parts for m, z in parts if k <= m + z and m + z % 3 <= k + s % 7)
    ordered = {r[0] for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey").collect()}
    known = {r[0] for r in spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey").collect()}
    sides = {(r["custkey"], r["side"]) for r in catalog.QUERIES["both_ways_absent_whole"](spark, sf).collect()}
    assert sides == {(c, "left") for c in ordered - known} | {(c, "right") for c in known - ordered}


def test_every_twentieth_title_is_asked(spark):
    from quillframe.functions import unicode as uni
    from quillframe.plans import catalog

    sf = "/root/testdata/sf0.001"
    part = spark.read.parquet(f"{sf}/part.parquet")
    got = defaultdict(list)
    for r in catalog.QUERIES["title_likeness"](spark, sf).orderBy("r").collect():
        got[r["query"]].append((r["score"], r["p_name"]))
    asked = part.where("p_partkey % 20 = 0").select(F.concat("p_name", F.lit(" two")).alias("query")).distinct()
    rows = asked.crossJoin(part.select("p_name").distinct()).select("query", "p_name", uni.title_likeness(F.col("query"), F.col("p_name")).alias("score")).collect()
    want = defaultdict(list)
    for r in rows:
        want[r["query"]].append((r["score"], r["p_name"]))
    assert len(want) > 5 and got == {q: sorted(x, key=lambda v: (-v[0], v[1]))[:3] for q, x in want.items()}
    names = asked.select(F.col("query").alias("name"))
    whole, blocks = (sorted(uni.most_alike_in_blocks(asked, names, block=b, asked_block=a).collect()) for b, a in ((4096, 256), (3, 2)))
    assert whole == blocks


def test_numbered_with_a_hot_time(spark):
    """A third of all rows share a time: places are right, and no task has them all."""
    df = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, 500).otherwise(F.col("id") % 1000).alias("t"))
    spread = df.repartitionByRange(12, "t", F.desc("id")).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert spread < 2 * 30_000 / 12
    got = tables.numbered(df, F.col("t"), F.desc("id"))
    want = sorted(((500 if i % 3 == 0 else i % 1000), -i) for i in range(30_000))
    assert [(r["t"], -r["id"]) for r in sorted(got.collect(), key=lambda r: r["position"])] == want
    assert got.agg(F.countDistinct("position"), F.min("position"), F.max("position")).first()[:] == (30_000, 1, 30_000)
    assert tables.numbered(df.where("false"), F.col("t"), F.col("id")).count() == 0


@pytest.mark.parametrize(("name", "most"), [("reconcile_flagship", 4), ("finished_eligibility", 5)])
def test_scans_of_eligibility(spark, name, most):
    """Tables are aggregated by title once, not once for each rule."""
    from quillframe.plans import catalog

    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("FileScan parquet") <= most

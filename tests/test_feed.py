"""The change feed and the recent lines as streams: ends of each kind, late and repeated lines, restarts."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillframe.operators import telemetry
from quillframe.streaming import feed as feeds
from quillframe.streaming import runs

LINES = "run string, cursor long, at timestamp, state string, message string"
START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def spark_with_timers(spark):
    feeds.use_rocksdb(spark)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


class Feed:
    """A folder of lines and a query that is started anew for each batch, so that each one comes from the checkpoint."""

    def __init__(self, spark, folder, make, mode, schema=LINES):
        self.spark, self.folder, self.make, self.mode, self.schema = spark, str(folder), make, mode, schema
        self.n = 0

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        out = []
        stream = self.make(runs.tail(self.spark, f"{self.folder}/in", self.schema))
        query = stream.writeStream.outputMode(self.mode).option("checkpointLocation", f"{self.folder}/at").foreachBatch(lambda df, n: out.extend(df.collect())).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        return out


@pytest.fixture
def feed(spark_with_timers, tmp_path):
    return Feed(spark_with_timers, tmp_path, lambda s: feeds.feed(s, "run", "cursor", "at", "state", "message", idle=300, most=2000, keep=5000, delay="100 seconds"), "append")


def brief(rows, run):
    return [(r["event"], r["cursor"], r["state"], r["message"]) for r in rows if r["run"] == run]


def test_lines_states_and_a_final_state(feed):
    got = feed.add([("a", 1, at(0), "running", "x"), ("a", 2, at(1), "running", "y"), ("b", 1, at(2), None, "only")])
    assert brief(got, "a") == [("log", 1, "running", "x"), ("progress", 1, "running", None), ("log", 2, "running", "y")]
    assert brief(got, "b") == [("log", 1, None, "only")]
    # A replayed line, one that comes before another one, and a line after the end.
    got = feed.add([("a", 2, at(1), "running", "y"), ("a", 4, at(4), "completed", "end"), ("b", 3, at(9), None, "third")])
    assert brief(got, "a") == [] and brief(got, "b") == []
    got = feed.add([("a", 3, at(3), "paused", "z"), ("a", 5, at(5), "running", "after"), ("b", 2, at(5), None, "second")])
    assert brief(got, "a") == [("log", 3, "paused", "z"), ("progress", 3, "paused", None), ("log", 4, "completed", "end"), ("progress", 4, "completed", None), ("done", 4, "completed", None)]
    assert brief(got, "b") == [("log", 2, None, "second"), ("log", 3, None, "third")]
    assert brief(feed.add([("a", 6, at(6), "running", "late"), ("a", 7, at(7), "failed", "again")]), "a") == []


def test_a_run_that_stands_still(feed):
    feed.add([("a", 1, at(0), "running", "x")])
    # The watermark (100 s behind) passes 300 s after the last line; another run has moved it.
    assert brief(feed.add([("b", 1, at(350), "running", "x")]), "a") == []
    got = feed.add([("b", 2, at(450), "running", "y")]) + feed.add([("b", 3, at(460), "running", "z")])
    assert brief(got, "a") == [("done", 1, "failed", "stalled")]
    assert [r["at"] for r in got if r["event"] == "done"] == [at(300)]
    assert brief(feed.add([("a", 2, at(470), "running", "too late")]), "a") == []


def test_a_run_that_lasts_too_long(feed):
    got = []
    for k in range(10):
        got += feed.add([("a", k + 1, at(250 * k), "running", f"line {k}")])
    ends = [r for r in got if r["event"] == "done"]
    assert [(r["state"], r["message"], r["at"]) for r in ends] == [("failed", "too long", at(2000))]
    assert sum(r["event"] == "log" for r in got if r["run"] == "a") >= 8


def test_a_line_that_never_comes(feed):
    """What is held is reported once the watermark has passed it, without the missing one."""
    assert brief(feed.add([("a", 1, at(0), "running", "x"), ("a", 3, at(10), "running", "z")]), "a") == [("log", 1, "running", "x"), ("progress", 1, "running", None)]
    got = feed.add([("b", 1, at(200), "running", "x")]) + feed.add([("b", 2, at(201), "running", "x")])
    assert brief(got, "a") == [("log", 3, "running", "z")]
    assert brief(feed.add([("a", 2, at(150), "running", "y"), ("a", 4, at(202), "cancelled", "stop")]), "a") == [("log", 4, "cancelled", "stop"), ("progress", 4, "cancelled", None), ("done", 4, "cancelled", None)]


def test_recent_lines(spark_with_timers, tmp_path):
    """Equal to the batch form after each batch, with replays, repeated lines and late ones."""
    schema = "run string, at timestamp, message string, line long"
    stream = Feed(spark_with_timers, tmp_path, lambda s: feeds.recent(s, "run", "at", "message", "line", most=5), "update", schema)
    rows = [("a", at(k // 2), f"m{k % 3}", k) for k in range(20)] + [("b", at(1), "one", 1)]
    image, seen = {}, []
    for batch in (rows[:4] + rows[-1:], rows[2:6], [rows[7], rows[6]], rows[8:20], rows[15:18]):
        seen += batch
        changed = stream.add(batch)
        for run in {r["run"] for r in changed}:
            image[run] = [(r["at"], r["message"], r["line"]) for r in sorted((x for x in changed if x["run"] == run), key=lambda x: x["place"])]
        want = telemetry.recent_lines(spark_with_timers.createDataFrame(seen, schema), "run", "at", "message", "line", 5).orderBy("run", "line").collect()
        assert image == {run: [(r["at"], r["message"], r["line"]) for r in want if r["run"] == run] for run in {r["run"] for r in want}}
    assert stream.add(rows[15:18]) == []


def test_lines_that_lack_something(feed):
    got = feed.add([(None, 1, at(0), "running", "x"), ("a", None, at(0), "running", "x"), ("a", 1, None, "running", "x"), ("a", 1, at(5), None, None)])
    assert [(r["run"], r["event"], r["message"]) for r in got] == [("a", "log", None)]

"""Limits and pacing with a key that has a third of all events, against one key after the other."""

from __future__ import annotations

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from quillframe.operators import limits


@pytest.fixture
def uncoalesced(spark):
    """Small partitions stay apart, as large ones would."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plain_limit(times, limit, window):
    held, out = deque(), []
    for t in times:
        while held and t - held[0] >= window:
            held.popleft()
        ok = len(held) < limit
        out.append((t, ok, 0 if ok else max(1, int(window - (t - held[0])))))
        if ok:
            held.append(t)
    return out


@pytest.mark.parametrize(("limit", "window"), [(1, 60.0), (3, 60.0), (10, 7.3)])
def test_limited(spark, limit, window):
    rng = random.Random(2)
    events = []
    for key in ["hot", "busy", "b", "c", None]:
        t = 0.0
        for _ in range(900 if key == "hot" else 120):
            t += rng.choice([0.0, 0.1, window / 3, window, 1.5, *([window * rng.uniform(0.5, 5)] * (key != "busy"))])
            events.append((key, t))
    df = spark.createDataFrame(rng.sample(events, len(events)), "k string, t double")
    got = sorted(map(tuple, limits.limited(df, "k", "t", limit, window).collect()), key=str)
    want = sorted(((k, *x) for k in ["hot", "busy", "b", "c", None] for x in plain_limit(sorted(t for key, t in events if key == k), limit, window)), key=str)
    assert got == want


def test_a_hot_key_is_spread(uncoalesced):
    """Half of all events have one key; it pauses often, so its events are in several tasks."""
    df = uncoalesced.range(8000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"), ((F.floor(F.col("id") / 40) * 1000) + F.col("id") % 40).cast("double").alias("t"))
    found = limits.limited(df, "k", "t", 3, 60.0)
    tasks = found.where("k = 0").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 1 and max(r["count"] for r in tasks) < 2500
    assert found.where("k = 0 and accepted").count() == 3 * 200


@pytest.mark.parametrize("recover", [2, 5])
def test_paced(uncoalesced, recover):
    rng = random.Random(6)
    events, n = [], 0
    for key in ["hot", "b", None, "c", "calm"]:
        for _ in range(700 if key == "hot" else 90):
            n += 1
            refused = rng.random() < {"calm": 0.0, "b": 0.8}.get(key, 0.3)
            events.append((key, n, rng.choice([refused, refused, refused, refused or None]), rng.choice([None, None, 7.0]) if refused else None))
    pacing = limits.Pacing(1.0, 5.0, recover)
    want = []
    for key in ["hot", "b", None, "c", "calm"]:
        state = pacing.new()
        want += [(*e, *pacing.step(state, e[2], e[3])) for e in events if e[0] == key]
    df = uncoalesced.createDataFrame(rng.sample(events, len(events)), "k string, n int, r boolean, h double")
    got = limits.paced(df, "k", "n", "r", "h", recover=recover)
    assert sorted(map(tuple, got.collect()), key=lambda x: x[1]) == sorted(want, key=lambda x: x[1])
    assert got.where("k = 'hot'").select(F.spark_partition_id()).distinct().count() > 1
    assert limits.paced(df.where("false"), "k", "n", "r", "h").count() == 0


def test_blocks_stand_for_their_events():
    """Whatever the state before, a block's short form leads to the state that its events lead to."""
    rng = random.Random(1)
    for _ in range(2000):
        pacing = limits.Pacing(1.0, 3.0, rng.choice([1, 2, 3]))
        state = pacing.new()
        for _ in range(rng.randrange(12)):
            pacing.step(state, rng.random() < 0.5, None)
        block = limits.Block()
        events = [rng.random() < rng.choice([0.1, 0.5, 0.9]) for _ in range(rng.randrange(15))]
        for refused in events:
            pacing.sum_up(block, refused)
        want = limits.Pace(state.rejections, state.interval, state.successes)
        for refused in events:
            pacing.step(want, refused, None)
        assert pacing.after(state, block) == want

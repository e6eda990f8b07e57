"""The table of upserts: equal to a dictionary that takes the same batches, with and without compaction."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillframe.operators.upsertlog import UpsertLog

SCHEMA = "k long, name string, v int, born int"


def batches(n):
    rng = random.Random(4)
    for number in range(n):
        rows = [(rng.choice([*range(40), None]), f"{number}-{i}", rng.choice([number, number, number - 2, None]), number * 100 + i) for i in range(rng.randrange(30))]
        # Rows of one batch with equal keys have different versions or one of them counts, so keys are told apart here.
        yield number, list({r[0]: r for r in rows}.values()), number % 4 == 3


def applied(state, number, rows, deleting):
    for k, name, v, born in rows:
        order = (v is not None, v or 0, number)
        old = state.get(k)
        first = (order, born) if old is None or order < old["first"][0] else old["first"]
        last = (order, name, v, deleting and name.endswith("1")) if old is None or order >= old["last"][0] else old["last"]
        state[k] = {"first": first, "last": last}


def image(state):
    return sorted(((k, s["last"][1], s["last"][2], s["first"][1]) for k, s in state.items() if not s["last"][3]), key=str)


@pytest.mark.parametrize("compacting", [False, True])
def test_like_a_dictionary(spark, tmp_path, compacting):
    empty = spark.createDataFrame([], SCHEMA)
    log = UpsertLog.create(spark, f"file://{tmp_path}/t", empty.schema, ["k"], "v", keep_first=("born",), buckets=4)
    assert log.read().count() == 0
    state, steps = {}, []
    for number, rows, deleting in batches(10):
        batch = spark.createDataFrame(rows, SCHEMA)
        gone = F.col("name").endswith("1") if deleting else None
        assert log.append(batch, number, gone)
        # A replay adds nothing, whatever it holds.
        assert not log.append(batch.withColumn("name", F.lit("again")), number, gone)
        applied(state, number, rows, deleting)
        if compacting:
            log.compact()
            log.vacuum(keep=1)
        steps.append(max(len(s) for s in log.manifest()[1]["live"].values()))
        if number in (0, 4, 9):
            assert sorted(map(tuple, log.read().collect()), key=str) == image(state)
    assert max(steps[3:]) <= (4 if compacting else 10) and (compacting or steps[-1] > 4)


def test_a_batch_writes_what_it_holds(spark, tmp_path):
    log = UpsertLog.create(spark, str(tmp_path / "t"), spark.createDataFrame([], SCHEMA).schema, ["k"], "v", buckets=8)
    log.append(spark.range(50_000).selectExpr("id as k", "concat('name ', id) as name", "1 as v", "1 as born"), 0)
    log.append(spark.createDataFrame([(7, "seven", 2, 2), (8, "eight", 0, 2), (-1, "new", 0, 2)], SCHEMA), 1)
    live = log.manifest()[1]["live"].values()
    sizes = {step: sum(size for steps in live for s, size in steps if s == step) for step in (1, 2)}
    assert sizes[2] < sizes[1] / 20
    # Buckets that only the first batch touched are read without a shuffle, and the small step doesn't pay to merge.
    assert log.compact() == 0
    assert {r["k"]: r["name"] for r in log.read().where("k in (-1, 7, 8)").collect()} == {-1: "new", 7: "seven", 8: "name 8"}
    assert log.read(1).count() == 50_000 and log.read().count() == 50_001


def test_a_crash_before_the_manifest(spark, tmp_path):
    """Files without a manifest are not read, and the batch that comes again replaces them."""
    log = UpsertLog.create(spark, str(tmp_path / "t"), spark.createDataFrame([], SCHEMA).schema, ["k"], "v")
    log.append(spark.createDataFrame([(1, "a", 1, 1)], SCHEMA), 0)
    whole = log._publish
    log._publish = lambda *_: (_ for _ in ()).throw(RuntimeError("lost"))
    batch = spark.createDataFrame([(1, "b", 2, 2), (2, "c", 2, 2)], SCHEMA)
    with pytest.raises(RuntimeError):
        log.append(batch, 1)
    assert [r["name"] for r in log.read().collect()] == ["a"]
    log._publish = whole
    assert log.append(batch, 1)
    assert sorted(r["name"] for r in log.read().collect()) == ["b", "c"]


def test_two_writers(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    log = UpsertLog.create(spark, str(tmp_path / "t"), schema, ["k"], "v")
    number, now = log.manifest()
    log._publish(number + 1, now)
    with pytest.raises(Exception, match="exist"):
        log._publish(number + 1, now)
    with pytest.raises(ValueError):
        UpsertLog.create(spark, str(tmp_path / "u"), spark.createDataFrame([], "k long, Step int").schema, ["k"], "k")

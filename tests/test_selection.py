"""Choosing rows and filling fields, on rows with nulls, ties and nothing at all."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quillframe.operators import selection as s


def test_names_and_keys(spark):
    df = spark.createDataFrame([("a_1", '{"x": null, "y": 1}'), ("b", "[1]"), (None, None), ("skip", "no json")], "k string, doc string")
    got = {r["k"]: r[1:] for r in df.select("k", s.named("k", also=("b",), like=("a%",)), s.named("k", never=("skip",)), s.named("k", unlike=("a%",)), s.has_key("doc", "x")).collect()}
    assert got == {"a_1": (True, True, False, True), "b": (True, True, True, False), None: (False, False, False, False), "skip": (False, False, True, False)}
    assert [(r["k"], r["key"]) for r in s.unknown_keys(df, "doc", ("y",)).collect()] == [("a_1", "x")]


def test_completed_refs(spark):
    def story(**more):
        return {"id": 1, "title": " A  b ", "story_status": "COMPLETE", "chapters_count": 3, "overall_rating_cache": 4, "reviews_count": "7", "user": {"username": "u"}, **more}

    stories = [story(), story(id=" 2 ", title="", test_title="t", chapters_count=3.5, overall_rating_cache=4.5, user=None), story(id=3, for_patrons_only=True), story(id=4, for_patrons_only="true", chapters_count=None, overall_rating_cache="5"), story(id=5, story_status="ongoing"), story(id=None), story(id=6, title=None), story(id=1, title="last", user=7)]
    rows = [(json.dumps({"stories": stories}),), ("{",), (None,), ('{"stories": 3}',), ("[]",)]
    got = sorted(tuple(r) for r in s.completed_refs(spark.createDataFrame(rows, "p string").coalesce(1), "p").collect())
    assert got == [("1", "last", "", 3, 4.0, None), ("2", "t", "", None, 4.5, None), ("4", "A b", "u", None, None, None)]


def test_access_and_revocation(spark):
    df = spark.createDataFrame([(1, True, False), (1, True, True), (1, None, None), (2, True, None)], "i int, c boolean, u boolean")
    assert sorted(tuple(r) for r in s.access_counts(df, "i", "c", "u").collect()) == [(1, 2, 1), (2, 0, 1)]
    tokens = spark.createDataFrame([(1, "a", None), (2, "a", 5), (3, "b", None), (4, None, None)], "t int, user string, at int")
    users = spark.createDataFrame([("a",), ("a",), (None,)], "user string")
    assert sorted(tuple(r) for r in s.revoked(tokens, users, "user", "at", F.lit(9)).collect()) == [(1, "a", 9, True), (2, "a", 5, False), (3, "b", None, False), (4, None, None, False)]


def test_id_map_and_ranges(spark):
    rows = [(1, 0, 2, "", "x", 1), (1, 2, None, "c", None, 2), (1, None, None, "zero", None, 3), (1, 3, 0, "", "", 4), (2, 2, 9, None, "y", 5)]
    df = spark.createDataFrame(rows, "item int, a int, b int, c string, d string, o int")
    wanted = spark.createDataFrame([(1, 2), (1, 2), (1, 0), (1, 3), (2, 2), (2, 9)], "item int, number int")
    assert sorted(tuple(r) for r in s.id_map(df, "item", ("a", "b"), ("c", "d"), "o", wanted).collect()) == [(1, 0, "zero"), (1, 2, "c"), (2, 2, "y")]
    assert [s.range_of(x) for x in ("3-7", " 0 - 2 ", "7-3", "3", "a-b", "1-2-3", "")] == [(3, 7), (1, 2), (7, 7), None, None, None, None]
    segments = spark.createDataFrame([(i, n) for i in (1, 2) for n in (-1, 0, 1, 2, 3, 4)], "i int, n int")
    starts = spark.createDataFrame([(2, 3)], "i int, start int")
    assert sorted(tuple(r) for r in s.chosen_segments(segments, "i", "n", starts=starts, limit=2).collect()) == [(1, 1), (1, 2), (2, 3), (2, 4)]
    assert sorted(tuple(r) for r in s.chosen_segments(segments, "i", "n", "2-3").collect()) == [(1, 2), (1, 3), (2, 2), (2, 3)]
    assert sorted(tuple(r) for r in s.chosen_segments(segments, "i", "n").collect()) == [(1, 1), (2, 1)]


@pytest.mark.parametrize(("active", "want"), [(0, [1, 2, 3]), (1, [1, 2]), (3, []), (9, [])])
def test_admission(spark, active, want):
    pending = spark.createDataFrame([(k, 10 - k // 2) for k in (4, 3, 2, 1)], "k int, t int")
    assert sorted(r["k"] for r in s.admitted(pending, spark.range(active), 3, F.col("k")).collect()) == want


def test_defaults_and_marks(spark):
    df = spark.createDataFrame([(None, "", "b"), ("a", None, None)], "x string, y string, z string")
    got = s.defaulted(df, {"x": ["y", "z"], "y": ["x", F.lit("none")], "w": ["x", "z"]}).collect()
    assert [tuple(r) for r in got] == [("b", "none", "b", "b"), ("a", "a", None, "a")]
    row = df.select(s.marked("z", "e:", F.upper("z")).alias("m"), s.marked("x", "a", F.lit("?")).alias("n"), s.history_id("cover", F.lit("f"), F.lit("done")).alias("h")).collect()
    assert [tuple(r) for r in row] == [("e:B", None, "cover-f-done"), (None, "a", "cover-f-done")]


def test_resolved_names(spark):
    names = spark.createDataFrame([("n1",), ("n1",), ("n2",), ("n3",), (None,)], "name string")
    items = spark.createDataFrame([("n1", 7, "t"), ("n1", 5, "t"), ("n2", 8, "none"), (None, 9, "t")], "name string, item int, title string")
    targets = spark.createDataFrame([("t", 3), ("t", 2), (None, 1)], "title string, target int")
    segments = spark.createDataFrame([(5,), (5,), (8,)], "item int")
    got = sorted((tuple(r) for r in s.resolved(names, items, targets, segments, "name", "title").collect()), key=str)
    assert got == [("n1", 5, 2, "ready", 2), ("n2", 8, None, "no_target", 0), ("n3", None, None, "no_folder", 0), (None, None, None, "no_folder", 0)]

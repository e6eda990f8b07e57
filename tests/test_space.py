"""Rectangles and points in crowded space, against all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillframe.operators import compare, space


def boxes(n, seed):
    """A third in a tiny corner, a few over everything, a few without extent, the rest anywhere."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        if k % 3 == 0:
            x, y, w, h = rng.uniform(70, 70.01), rng.uniform(30, 30.01), rng.uniform(0, 0.001), rng.uniform(0, 0.001)
        elif k % 50 == 1:
            x, y, w, h = -5.0, -5.0, 1000.0, 1000.0
        elif k % 50 == 2:
            x, y, w, h = float(rng.randrange(10)), float(rng.randrange(10)), 0.0, 0.0
        else:
            x, y, w, h = rng.uniform(0, 900), rng.uniform(0, 500), rng.uniform(0, 20), rng.choice([5.0, 10.0])
        out.append((k, x, y, x + w, y + h))
    return out


@pytest.mark.parametrize("most", [20, 4096])
def test_rectangles(spark, monkeypatch, most):
    monkeypatch.setattr(space, "CELL_ROWS", most)
    one, two = boxes(300, 1), boxes(240, 2) + [(900, None, 0.0, 1.0, 1.0), (901, 5.0, 5.0, 4.0, 6.0), (902, 0.0, 0.0, float("inf"), 1.0), (903, float("nan"), 0.0, 1.0, 1.0)]
    want = sorted((p[0], q[0]) for p in one for q in two[:240] if max(p[1], q[1]) <= min(p[3], q[3]) and max(p[2], q[2]) <= min(p[4], q[4]))
    schema = "k long, left double, top double, right double, bottom double"
    a, b = (spark.createDataFrame(x, schema) for x in (one, two))
    make = lambda df: space.rectangles(df, "k", "left", "top", "right", "bottom")
    assert sorted((r["a_id"], r["b_id"]) for r in space.met(make(a), make(b)).collect()) == want
    inside = sorted((p[0], q[0]) for p in one for q in one if max(p[1], q[1]) < min(p[3], q[3]) and max(p[2], q[2]) < min(p[4], q[4]))
    assert sorted(map(tuple, compare.overlapping_boxes(a, a, "k").collect())) == inside
    assert space.met(make(a), make(b.where("false"))).count() == 0 and space.met(make(a.where("false")), make(b.where("false"))).count() == 0


def test_crowded_cells_are_split(spark, monkeypatch):
    """A third of all rows in one corner: no cell that is joined has many of them."""
    monkeypatch.setattr(space, "CELL_ROWS", 200)
    seen = []
    whole = space.reduce

    def watched(fn, parts):
        out = whole(fn, parts)
        seen.append(out.groupBy("level", "cx", "cy").count().agg(F.max("count"), F.sum("count")).first())
        return out

    monkeypatch.setattr(space, "reduce", watched)
    rng = random.Random(5)
    points = [(k, *((rng.uniform(1, 1.001), rng.uniform(2, 2.001)) if k % 3 == 0 else (rng.uniform(0, 5000), rng.uniform(0, 5000)))) for k in range(6000)]
    df = spark.createDataFrame(points, "k long, x double, y double")
    got = sorted(map(tuple, compare.near(df, "k", "x", "y", 0.00002).collect()))
    cells = {}
    for k, x, y in points:
        cells.setdefault((x // 0.00002, y // 0.00002), []).append((k, x, y))
    want = sorted((k, j) for (cx, cy), inside in cells.items() for k, x, y in inside for dx in (-1, 0, 1) for dy in (-1, 0, 1) for j, u, v in cells.get((cx + dx, cy + dy), []) if k < j and (x - u) ** 2 + (y - v) ** 2 <= 0.00002**2)
    assert got == want and len(want) > 100
    # Both sides have 6,000 rows, and few are copied at the edges of cells.
    assert seen[0][0] <= 200 and seen[0][1] < 14_000

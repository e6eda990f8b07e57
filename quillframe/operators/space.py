"""Joins of rectangles and points over unevenly filled space.

Space is split as a quadtree by what lies in it: rows start in the cells of a uniform grid that they touch, and cells with many rows
hand theirs on to the smaller cells within them, until a cell holds few.  A cell that rows of one side only touch is dropped at
once.  Where most rows of a cell cover all of it, splitting would only copy them, and nearly all of them meet anyway: there the
rows of one side are dealt to blocks, which the other side visits.  So no task has all rows of a crowded cell.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.sources.store import written

#: Rows of a cell, beyond which it is split.
CELL_ROWS = 4096
#: Levels that a split goes down at once: a cell has 4 ** SPLIT cells within it.
SPLIT = 2
#: Beyond this level cells are as small as the precision of the numbers allows.
DEEPEST = 26


def rectangles(df: DataFrame, key: str, left: str | Column, top: str | Column, right: str | Column, bottom: str | Column, *more: Column) -> DataFrame:
    """``id, l, t, r, b`` and ``more`` of a table, as ``met`` takes them; edges are doubles."""
    edge = lambda c: (F.col(c) if isinstance(c, str) else c).cast("double")
    return df.select(F.col(key).alias("id"), edge(left).alias("l"), edge(top).alias("t"), edge(right).alias("r"), edge(bottom).alias("b"), *more)


def _cell(edge: Column, low: Column | float, unit: float, level: Column | int) -> Column:
    # The factor is a power of two, so cells of one level lie exactly within those of another.
    return F.floor((edge - low) / F.lit(unit) * F.pow(F.lit(2.0), level if isinstance(level, Column) else F.lit(float(level))))


def _posted(rows: DataFrame, low: tuple[float, float], unit: float, level: int, within: int = 0) -> DataFrame:
    """Rows with the cells ``cx, cy`` of a level that they touch; ``within``: only those in their cell so many levels above."""

    def span(first: str, last: str, origin: float, cell: str) -> Column:
        a, z = _cell(F.col(first), origin, unit, level), _cell(F.col(last), origin, unit, level)
        if within:
            a, z = F.greatest(a, F.col(cell) * (1 << within)), F.least(z, F.col(cell) * (1 << within) + (1 << within) - 1)
        return F.explode(F.sequence(a, z))

    out = rows.withColumn("nx", span("l", "r", low[0], "cx")).withColumn("ny", span("t", "b", low[1], "cy"))
    return out.drop("cx", "cy").withColumnsRenamed({"nx": "cx", "ny": "cy"})


def met(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of rectangles (``id, l, t, r, b``) of the two sides that meet, edges included, once each: ``a_id, a_l, ..., b_id, b_l, ...``.

    Both sides may have more columns, the same ones, but for ``side, cx, cy, nx, ny, blocks, block, level``.  A pair counts in the cell that holds the upper left corner of what the two share.  Rows with a null or infinite edge, or edges in
    the wrong order, meet nothing; rows of equal ids are rows of their own.
    """
    spark = a.sparkSession
    names = ["l", "t", "r", "b"]
    finite = " and ".join(f"{c} is not null and abs({c}) < double('infinity')" for c in names)
    rows = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1))).where(f"{finite} and l <= r and t <= b")
    rows = written(rows)
    n, x, y, right, bottom = rows.agg(F.count("*"), F.min("l"), F.min("t"), F.max("r"), F.max("b")).first()
    columns = [F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("a", "b") for c in a.columns]
    if not n:
        return a.alias("a").join(b.alias("b"), F.lit(False)).select(columns)
    low, unit = (x, y), max(right - x, bottom - y) or 1.0
    level = min(max(0, math.ceil(math.log(max(n / CELL_ROWS, 1), 4))), DEEPEST)
    posted, settled = _posted(rows, low, unit, level), []
    while True:
        posted = written(posted)
        # A row is loose in a cell unless it covers all of it.
        inner = (_cell(F.col("l"), x, unit, level) >= F.col("cx")) | (_cell(F.col("r"), x, unit, level) <= F.col("cx"))
        inner = inner | (_cell(F.col("t"), y, unit, level) >= F.col("cy")) | (_cell(F.col("b"), y, unit, level) <= F.col("cy"))
        cells = posted.groupBy("cx", "cy").agg(F.count_if(F.col("side") == 0).alias("n_a"), F.count_if(F.col("side") == 1).alias("n_b"), F.count_if(inner).alias("loose"))
        cells = written(cells.where("n_a > 0 and n_b > 0"))
        crowded = (F.col("n_a") + F.col("n_b") > CELL_ROWS) & (2 * F.col("loose") > F.col("n_a") + F.col("n_b")) & F.lit(level + SPLIT <= DEEPEST)
        blocks = F.ceil(F.col("n_a") / CELL_ROWS).cast("int").alias("blocks")
        settled.append(posted.join(cells.where(~crowded).select("cx", "cy", blocks), ["cx", "cy"]).withColumn("level", F.lit(level)))
        hot = cells.where(crowded).select("cx", "cy")
        if hot.isEmpty():
            break
        level += SPLIT
        posted = _posted(posted.join(hot, ["cx", "cy"]), low, unit, level, SPLIT)
    rows = reduce(DataFrame.unionByName, settled)
    one = rows.where("side = 0").withColumn("block", F.pmod(F.xxhash64("id", *names), F.col("blocks")).cast("int"))
    two = rows.where("side = 1").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["level", "cx", "cy", "block"]
    pairs = one.alias("a").join(two.alias("b"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])
    corner = (F.greatest("a.l", "b.l"), F.greatest("a.t", "b.t"))
    meet = (corner[0] <= F.least("a.r", "b.r")) & (corner[1] <= F.least("a.b", "b.b"))
    here = (_cell(corner[0], x, unit, F.col("a.level")) == F.col("a.cx")) & (_cell(corner[1], y, unit, F.col("a.level")) == F.col("a.cy"))
    return pairs.where(meet & here).select(columns)

"""Comparing a source with a target: presence, full outer comparison with classified outcomes, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.operators.helpers import unused
from quillframe.operators.space import met, rectangles
from quillframe.sources.store import written

#: Rows of the input of which those with equal ranges go as one.
CHUNK = 1 << 14
#: Rows of one side of a crowded cell that meet as many of the other in one place.
BLOCK = 4096


def present(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``left`` whose key is in ``right``."""
    return left.join(right.select(*on), on, "left_semi")


def absent(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``left`` whose key is not in ``right``; null keys are never in it."""
    return left.join(right.select(*on), on, "left_anti")


def absent_either_way(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Keys of one side only, with ``side`` 'left' or 'right'."""
    return absent(left, right, on).select(*on, F.lit("left").alias("side")).unionByName(absent(right, left, on).select(*on, F.lit("right").alias("side")))


def compared(left: DataFrame, right: DataFrame, on: list[str], same: Column, labels: tuple[str, str, str, str] = ("same", "different", "missing_right", "right_only")) -> DataFrame:
    """Full outer comparison: all columns of both sides and ``outcome``.

    Other columns than the keys must have different names on the two sides; ``same`` says whether a
    matched pair agrees (null counts as no).
    """
    in_left, in_right = unused("_in_left", left, right), unused("_in_right", left, right)
    both = left.withColumn(in_left, F.lit(True)).join(right.withColumn(in_right, F.lit(True)), on, "full")
    outcome = (
        F.when(F.col(in_right).isNull(), labels[2])
        .when(F.col(in_left).isNull(), labels[3])
        .when(F.coalesce(same, F.lit(False)), labels[0])
        .otherwise(labels[1])
    )
    return both.withColumn("outcome", outcome).drop(in_left, in_right)


def with_fallback(left: DataFrame, by_id: DataFrame, by_title: DataFrame, id_key: str, title_key: str, value: str) -> DataFrame:
    """``left`` with a value found by id, or else by title; each lookup has one row per key."""
    a = by_id.select(id_key, F.col(value).alias("_by_id"))
    b = by_title.select(title_key, F.col(value).alias("_by_title"))
    return left.join(a, id_key, "left").join(b, title_key, "left").withColumn(value, F.coalesce("_by_id", "_by_title")).drop("_by_id", "_by_title")


def near(points: DataFrame, key: str, x: str, y: str, radius: float) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of points within ``radius`` of each other.

    Points meet the squares around others in the cells of a quadtree, which are the smaller the more points lie there.
    """
    px, py = (F.col(c).cast("double") for c in (x, y))
    own = (px.alias("px"), py.alias("py"))
    # Squares are a little wider than need be, so that rounding of their edges loses no pair.
    wide = lambda p: F.lit(radius) * 1.000001 + F.abs(p) * 1e-12
    pairs = met(rectangles(points, key, px, py, px, py, *own), rectangles(points, key, px - wide(px), py - wide(py), px + wide(px), py + wide(py), *own))
    square = lambda c: c * c
    close = square(F.col("a_px") - F.col("b_px")) + square(F.col("a_py") - F.col("b_py")) <= radius * radius
    return pairs.where((F.col("a_id") < F.col("b_id")) & close).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def near_boxes(boxes: DataFrame, key: str, x: str, y: str, size: str, largest: float, share: float = 0.5) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of boxes whose centres are no further apart than ``share`` of the larger one's size.

    ``largest`` bounds the sizes.  Centres that are within ``share * largest`` meet on a grid, and each pair is then held against
    its own radius.
    """
    pairs = near(boxes, key, x, y, share * largest)
    box = lambda name: boxes.select(F.col(key).alias(name), *(F.col(c).cast("double").alias(f"{name}_{k}") for c, k in ((x, "x"), (y, "y"), (size, "s"))))
    rows = pairs.join(box("a"), "a").join(box("b"), "b")
    dx, dy, radius = F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y"), share * F.greatest("a_s", "b_s")
    return rows.where(dx * dx + dy * dy <= radius * radius).select("a", "b")


def overlapping_boxes(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Pairs ``(a, b)`` of rectangles ``left, top, right, bottom`` that share more than an edge."""
    sides = [rectangles(df.where("left < right and top < bottom"), key, "left", "top", "right", "bottom") for df in (a, b)]
    inside = (F.greatest("a_l", "b_l") < F.least("a_r", "b_r")) & (F.greatest("a_t", "b_t") < F.least("a_b", "b_b"))
    return met(*sides).where(inside).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def contents(targets: DataFrame, files: DataFrame, item: str, ordinal: str, text: str, name: str, declared: DataFrame | None = None) -> DataFrame:
    """``item, ordinal, outcome, file`` of an item's target segments against its files: same, different, missing_drive, drive_only.

    Of several files for an ordinal the last by name counts.  A target without segments is taken to have those from 1 to
    its declared maximum (``item, declared``); such a segment has no text, so a file for it is different.
    """
    left = targets.where(F.col(ordinal).isNotNull()).groupBy(item, ordinal).agg(F.max(text).alias("_target"))
    if declared is not None:
        bare = declared.where("declared > 0").join(left.select(item), item, "left_anti")
        assumed = bare.select(item, F.explode(F.sequence(F.lit(1), F.col("declared").cast("int"))).alias(ordinal), F.lit(None).cast("string").alias("_target"))
        assumed = assumed.withColumn(ordinal, F.col(ordinal).cast(left.schema[ordinal].dataType))
        left = left.unionByName(assumed)
    right = files.where(F.col(ordinal).isNotNull()).groupBy(item, ordinal).agg(F.max_by(text, name).alias("_file"), F.max(name).alias("file"))
    found = compared(left, right, [item, ordinal], F.col("_target") == F.col("_file"), ("same", "different", "missing_drive", "drive_only"))
    return found.select(item, ordinal, "outcome", "file")


def content_summary(found: DataFrame, item: str) -> DataFrame:
    """Per item the numbers of outcomes; ``total`` counts the target's segments only."""
    outcomes = ("same", "different", "missing_drive", "drive_only")
    return found.groupBy(item).agg(F.count_if(F.col("outcome") != "drive_only").alias("total"), *(F.count_if(F.col("outcome") == o).alias(o) for o in outcomes))


def overlapping(a: DataFrame, b: DataFrame, low: str, high: str, width: int) -> DataFrame:
    """Pairs of rows whose ranges ``low..high`` overlap, once each.

    Rows of equal ranges go as one, so many at most as the input has in CHUNK rows on end.  They are posted under every ``width``-wide
    cell that they touch, and a pair counts in the cell where the later one starts.  In a crowded cell both sides are dealt to blocks,
    and every two blocks meet in a place of their own.  Columns come out as ``a_*`` and ``b_*``.
    """

    def posted(df: DataFrame, name: str) -> DataFrame:
        ends = [F.col(c).alias(f"{name}_{c}") for c in (low, high)]
        more = F.struct(*(F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in (low, high)), F.lit(0).alias("_"))
        rows = written(df.where(F.col(low) <= F.col(high)).select(*ends, more.alias("row")))
        rows = rows.withColumn("chunk", F.floor(F.monotonically_increasing_id() / CHUNK))
        groups = rows.groupBy(f"{name}_{low}", f"{name}_{high}", "chunk").agg(F.collect_list("row").alias(f"{name}_rows"))
        cells = F.explode(F.sequence(F.floor(F.col(f"{name}_{low}") / width), F.floor(F.col(f"{name}_{high}") / width))).alias("cell")
        return written(groups.select("*", cells))

    one, two = posted(a, "a"), posted(b, "b")
    sizes = one.select("cell", F.size("a_rows").alias("a"), F.lit(0).alias("b")).unionByName(two.select("cell", F.lit(0).alias("a"), F.size("b_rows").alias("b")))
    blocks = lambda c: F.ceil(F.sum(c) / BLOCK).cast("int").alias(f"{c}_blocks")
    crowded = sizes.groupBy("cell").agg(blocks("a"), blocks("b")).where("a_blocks > 0 and b_blocks > 0 and a_blocks + b_blocks > 2")

    def dealt(groups: DataFrame, own: str, other: str) -> DataFrame:
        rows = groups.join(crowded, "cell", "left").withColumn(f"{own}_block", F.pmod(F.xxhash64(f"{own}_{low}", f"{own}_{high}", "chunk"), F.coalesce(f"{own}_blocks", F.lit(1))).cast("int"))
        met = F.explode(F.sequence(F.lit(0), F.coalesce(f"{other}_blocks", F.lit(1)) - 1))
        return rows.withColumn(f"{other}_block", met).drop("a_blocks", "b_blocks", "chunk").repartition(places, *keys)

    # Few rows may stand for many pairs, so no side is broadcast, and places are not drawn together by their bytes.
    keys, places = ["cell", "a_block", "b_block"], int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = dealt(one, "a", "b").join(dealt(two, "b", "a").hint("merge"), keys)
    start = F.greatest(F.col(f"a_{low}"), F.col(f"b_{low}"))
    meet = (F.col(f"a_{low}") <= F.col(f"b_{high}")) & (F.col(f"b_{low}") <= F.col(f"a_{high}"))
    pairs = pairs.where(meet & (F.col("cell") == F.floor(start / width)))
    for name in ("a", "b"):
        pairs = pairs.withColumn(f"{name}_row", F.explode(f"{name}_rows")).drop(f"{name}_rows")
    column = lambda name, c: F.col(f"{name}_{c}") if c in (low, high) else F.col(f"{name}_row.{name}_{c}")
    return pairs.select(*(column(name, c) for name, df in (("a", a), ("b", b)) for c in df.columns))


def suffix_match(rows: DataFrame, suffixes: str, names: DataFrame, name: str, row_key: str) -> DataFrame:
    """Each row with the longest of its ``suffixes`` (longest first) that is a name; null where none is."""
    tried = rows.select(row_key, F.posexplode(suffixes).alias("pos", name))
    found = tried.join(names.select(name), name).groupBy(row_key).agg(F.min_by(name, "pos").alias(name))
    return rows.join(found, row_key, "left")


def common_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """Columns of both, in the order of the first."""
    return [c for c in a.columns if c in set(b.columns)]

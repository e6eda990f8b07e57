"""Ordered segments of series: duplicates, gaps, combining, what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_groups(df: DataFrame, key: Column, member: Column) -> DataFrame:
    """``key, n, members`` of keys that several rows have; members sorted."""
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(member)).alias("members")).where("n > 1")


def duplicate_ordinals(df: DataFrame, group: str, ordinal: str) -> DataFrame:
    """Ordinals that a group has more than once, with how often."""
    return df.where(F.col(ordinal).isNotNull()).groupBy(group, ordinal).agg(F.count("*").alias("n")).where("n > 1")


def ordinal_summary(df: DataFrame, group: str, ordinal: str) -> DataFrame:
    """Per group: first and last ordinal, number of segments, distinct ordinals, repeats, and missing ordinals.

    Ordinals are counted per value first, so a group's array holds each ordinal once.
    """
    each = df.where(F.col(ordinal).isNotNull()).groupBy(group, ordinal).agg(F.count("*").alias("_times"))
    per = each.groupBy(group).agg(
        F.min(ordinal).alias("first"),
        F.max(ordinal).alias("last"),
        F.sum("_times").alias("segments"),
        F.count("*").alias("distinct_ordinals"),
        F.array_sort(F.collect_list(F.when(F.col("_times") > 1, F.col(ordinal)))).alias("repeated"),
        F.collect_list(ordinal).alias("present"),
    )
    return per.withColumn("missing", F.array_except(F.sequence("first", "last"), "present")).drop("present")


def combined(df: DataFrame, group: str, ordinal: str, title: Column, body: Column, separator: str = "\n\n---\n\n") -> DataFrame:
    """One text per group: its segments in order, each under its title."""
    part = F.concat(F.lit("## "), title, F.lit("\n\n"), body)
    rows = F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("n"), part.alias("part"))))
    return df.groupBy(group).agg(F.count("*").alias("segments"), rows.alias("rows")).select(group, "segments", F.array_join(F.transform("rows", lambda r: r["part"]), separator).alias("text"))


def manifest(df: DataFrame, group: str, ordinal: str, title: Column, body: Column) -> DataFrame:
    """``group, manifest``: a JSON object with the group, the number of its segments and these, in order."""
    row = F.struct(F.col(ordinal).alias("number"), title.alias("title"), body.alias("content"))
    held = df.groupBy(group).agg(F.array_sort(F.collect_list(row)).alias("chapters"))
    return held.select(group, F.to_json(F.struct(F.col(group).alias("id"), F.size("chapters").alias("chapter_count"), "chapters")).alias("manifest"))


def with_header(title: Column, url: Column, status: Column, segments: Column, text: Column) -> Column:
    """A combined text under a header; lines of unknown fields are left out."""
    return F.concat_ws("\n", F.concat(F.lit("# "), title), F.concat(F.lit("Source: "), url), F.concat(F.lit("Status: "), status), F.concat(F.lit("Chapters: "), segments.cast("string")), F.lit(""), text)


def missing_segments(segments: DataFrame, present: DataFrame, group: str, ordinal: str, on: str) -> DataFrame:
    """Groups with segments that have no match in ``present``: ``group, missing, total, ordinals``."""
    have = present.select(F.col(on), F.lit(True).alias("_has")).dropDuplicates([on])
    rows = segments.join(have, on, "left")
    lacking = F.when(F.col("_has").isNull(), F.col(ordinal))
    return rows.groupBy(group).agg(F.count(lacking).alias("missing"), F.count("*").alias("total"), F.array_sort(F.collect_list(lacking)).alias("ordinals")).where("missing > 0")


def true_max(live_max: Column, count: Column) -> Column:
    """Highest ordinal of a target: of its live list, or else its count, or 0; a declared number is never used."""
    return F.coalesce(F.when(live_max > 0, live_max), F.nullif(count, F.lit(0)), F.lit(0))


def first_filled(df: DataFrame, group: str, order: str, *columns: str) -> DataFrame:
    """Per group the first non-null value of each column, in order."""
    return df.groupBy(group).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns))


def slots(occupied: Column, wanted: Column) -> Column:
    """Ordinals for new segments, in order: a segment's own number, or else the next one after all so far; taken ones are skipped.

    ``wanted`` holds the numbers of an item's new segments, null where a segment has none.  Numbering goes on after the
    greatest occupied ordinal.
    """
    none = F.array().cast("array<int>")
    taken = F.coalesce(occupied.cast("array<int>"), none)
    begin = F.struct(none.alias("planned"), (F.coalesce(F.array_max(taken), F.lit(0)) + 1).alias("next"))

    def step(a: Column, w: Column) -> Column:
        first = F.coalesce(w, a["next"])
        # Among so many ordinals one is free.
        reach = first + F.size(taken) + F.size(a["planned"])
        free = F.array_min(F.array_except(F.sequence(first, reach), F.concat(taken, a["planned"])))
        return F.struct(F.array_append(a["planned"], free).alias("planned"), F.greatest(a["next"], free + 1).alias("next"))

    return F.aggregate(wanted.cast("array<int>"), begin, step, lambda a: a["planned"])


def free_slots(occupied: Column, n: Column) -> Column:
    """The ``n`` ordinals after the greatest occupied one."""
    return slots(occupied, F.array_repeat(F.lit(None).cast("int"), n))


def wanted_slots(files: DataFrame, existing: DataFrame, item: str, ordinal: str, *order: Column) -> DataFrame:
    """``files`` that an item still lacks, with the ordinal ``slot`` under which each is to be posted.

    ``files`` has ``item, ordinal`` (null: not numbered); numbered ones up to the greatest existing ordinal are there already.
    ``existing`` has ``item, ordinal``.  An item's files are one list, as each slot depends on those before.
    """
    have = existing.groupBy(item).agg(F.collect_set(ordinal).alias("_have"), F.max(ordinal).alias("_top"))
    open_ = files.join(have, item, "left").where(F.col(ordinal).isNull() | (F.col(ordinal) > F.coalesce("_top", F.lit(0))))
    row = F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order)), F.struct(*(F.col(c) for c in files.columns)).alias("row"))
    per = open_.groupBy(item).agg(F.first("_have").alias("_have"), F.array_sort(F.collect_list(row)).alias("_rows"))
    per = per.withColumn("_slots", slots(F.col("_have"), F.transform("_rows", lambda r: r["row"][ordinal])))
    return per.select(F.explode(F.arrays_zip("_rows", "_slots")).alias("z")).select("z._rows.row.*", F.col("z._slots").alias("slot"))


def missing_audio(segments: DataFrame, voices: DataFrame, series: str, ordinal: str, url: str, voice: str, position: str, threshold: int = 0) -> DataFrame:
    """``series, ordinal, missing, voice`` of segments without audio, with how many their series lacks and its first voice that is not empty.

    Nothing comes out if no more than ``threshold`` segments are missing in all.
    """
    lacking = segments.where(F.coalesce(F.col(url), F.lit("")) == "").select(series, ordinal)
    # Two small sums stand for all segments: one number per series, and one for the whole.
    counts = lacking.groupBy(series).agg(F.count("*").alias("missing"))
    gate = counts.agg(F.coalesce(F.sum("missing"), F.lit(0)).alias("_all")).where(F.col("_all") > threshold)
    named = voices.where(F.coalesce(F.col(voice), F.lit("")) != "").groupBy(series).agg(F.min_by(voice, position).alias("voice"))
    return lacking.join(counts, series).join(named, series, "left").join(F.broadcast(gate), F.lit(True)).drop("_all")

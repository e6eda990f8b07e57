"""Choosing rows and filling fields: names and keys, completed series, access, revocation, ranges, admission, lookups by name."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillframe.functions.text import clean_line
from quillframe.operators.dedup import last_wins
from quillframe.operators.helpers import unused


def named(key: str | Column, also: tuple[str, ...] = (), like: tuple[str, ...] = (), never: tuple[str, ...] = (), unlike: tuple[str, ...] = ()) -> Column:
    """Is a key one of ``also`` or like one of ``like``, and none of ``never`` nor like one of ``unlike``?

    Without ``also`` and ``like`` any key will do.  A null key is no name: false, where SQL's NOT IN would be null.
    """
    c = F.col(key) if isinstance(key, str) else key
    wanted = F.lit(not also and not like)
    for test in [*([c.isin(*also)] if also else []), *(F.like(c, F.lit(p)) for p in like)]:
        wanted = wanted | test
    for test in [*([c.isin(*never)] if never else []), *(F.like(c, F.lit(p)) for p in unlike)]:
        wanted = wanted & ~test
    return F.coalesce(wanted, F.lit(False))


def has_key(document: str, key: str) -> Column:
    """Does a JSON object have a key, even one whose value is null?"""
    return F.coalesce(F.array_contains(F.json_object_keys(F.col(document)), key), F.lit(False))


def unknown_keys(df: DataFrame, document: str, known: tuple[str, ...], unlike: tuple[str, ...] = ()) -> DataFrame:
    """``df``'s rows for each key of their JSON object that is not known, in a column ``key``."""
    keys = df.withColumn("key", F.explode(F.json_object_keys(F.col(document))))
    return keys.where(named("key", never=known, unlike=unlike))


def _of_kind(value: Column, path: str, kinds: tuple[str, ...], as_type: str) -> Column:
    """A field of a variant where it has one of the kinds, else null: a number in a text is none."""
    own = F.try_variant_get(value, path, "variant")
    return F.when(F.schema_of_variant(own).isin(*kinds) | F.rlike(F.schema_of_variant(own), F.lit("^DECIMAL") if "DECIMAL" in kinds else F.lit("^$")), F.try_variant_get(value, path, as_type))


def completed_refs(documents: DataFrame, column: str) -> DataFrame:
    """``id, title, author, segments, rating, reviews`` of the completed series in payloads ``{"stories": [...]}``; of equal ids the last.

    A series needs an id, a title and the status 'complete', and must not be for patrons only (the value true, not a text).  Counts are taken if
    they are whole numbers, a rating if it is a number; texts and broken values give null.  What is no payload gives no row.
    """
    text = lambda path: F.coalesce(F.try_variant_get("s", path, "string"), F.lit(""))
    rows = documents.select(F.monotonically_increasing_id().alias("doc"), F.posexplode(F.try_variant_get(F.try_parse_json(column), "$.stories", "array<variant>")).alias("pos", "s"))
    first = lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b)
    whole = lambda path: _of_kind(F.col("s"), path, ("BIGINT",), "long")
    found = rows.select(
        "doc", "pos", F.trim(text("$.id")).alias("id"), clean_line(first(text("$.title"), text("$.test_title"))).alias("title"),
        clean_line(first(text("$.user.name"), text("$.user.username"))).alias("author"), whole("$.chapters_count").alias("segments"),
        _of_kind(F.col("s"), "$.overall_rating_cache", ("BIGINT", "DOUBLE", "DECIMAL"), "double").alias("rating"), whole("$.reviews_count").alias("reviews"),
        (F.lower(text("$.story_status")) == "complete").alias("done"), F.coalesce(_of_kind(F.col("s"), "$.for_patrons_only", ("BOOLEAN",), "boolean"), F.lit(False)).alias("patrons"),
    )
    good = found.where("id <> '' and title <> '' and done and not patrons")
    return last_wins(good, ["id"], F.col("doc"), F.col("pos")).drop("doc", "pos", "done", "patrons")


def queue_lists(jobs: DataFrame, state: str, lists: tuple[str, ...] = ("processing", "queued")) -> DataFrame:
    """The jobs in one of the lists, with ``in_list``, their list's number of jobs; other states are left out."""
    rows = jobs.where(F.col(state).isin(*lists))
    counts = rows.groupBy(state).agg(F.count("*").alias("in_list"))
    return rows.join(F.broadcast(counts), state)


def email_key(c: str | Column) -> Column:
    """An address as it is compared: without blanks around it, in lower case; null as ''."""
    return F.lower(F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))))


def readable(charge: str, unlock: str) -> Column:
    """Is a segment free, or unlocked?  A null charge is none, and a null unlock too."""
    return ~F.coalesce(F.col(charge), F.lit(False)) | F.coalesce(F.col(unlock), F.lit(False))


def access_counts(segments: DataFrame, item: str, charge: str, unlock: str) -> DataFrame:
    """``item, free, paid``: how many segments of each item can be read, and how many not."""
    return segments.groupBy(item).agg(F.count_if(readable(charge, unlock)).alias("free"), F.count_if(~readable(charge, unlock)).alias("paid"))


def revoked(tokens: DataFrame, users: DataFrame, user: str, at: str, now: Column) -> DataFrame:
    """The tokens' new image: those of ``users`` that are not revoked yet (``at`` is null) are revoked ``now``.

    Users are joined, so their number doesn't matter; ``revoked_now`` marks what has changed.
    """
    hit, kept = unused("_hit", tokens), tokens.columns
    wanted = users.select(F.col(user).alias(hit)).distinct()
    rows = tokens.join(wanted, F.col(user) == F.col(hit), "left")
    change = F.col(hit).isNotNull() & F.col(at).isNull()
    return rows.withColumn("revoked_now", change).withColumn(at, F.when(F.col("revoked_now"), now).otherwise(F.col(at))).select(*kept, "revoked_now")


def id_map(segments: DataFrame, item: str, numbers: tuple[str, ...], ids: tuple[str, ...], order: str, wanted: DataFrame) -> DataFrame:
    """``item, number, id`` for the ``wanted`` (item, number): a segment's number and id are the first filled of several fields.

    A number that is null or 0 is passed over for the next field, and is 0 in the end; an empty id is none.  Of equal numbers the last by ``order`` counts.
    """
    number = F.coalesce(*(F.nullif(F.col(c).cast("int"), F.lit(0)) for c in numbers), F.lit(0))
    own = F.coalesce(*(F.nullif(F.col(c).cast("string"), F.lit("")) for c in ids))
    rows = segments.select(item, number.alias("number"), own.alias("id"), F.col(order).alias("_order")).where("id is not null")
    return last_wins(rows.join(wanted.select(item, "number").distinct(), [item, "number"], "left_semi"), [item, "number"], F.col("_order"), F.col("id")).drop("_order")


def range_of(text: str) -> tuple[int, int] | None:
    """The bounds in ``3-7``: the first at least 1, the last not below the first; None for what is no range."""
    found = re.fullmatch(r"\s*(-?\d+)\s*-\s*(-?\d+)\s*", text)
    if not found or text.count("-") != 1:
        return None
    first = max(1, int(found[1]))
    return first, max(first, int(found[2]))


def chosen_segments(segments: DataFrame, item: str, ordinal: str, chosen: str = "", starts: DataFrame | None = None, limit: int = 1) -> DataFrame:
    """Each item's segments in the range ``chosen`` (``3-7``), or else the first ``limit`` from its start on.

    ``starts`` has ``item, start``; an item without one starts at 1.
    """
    bounds = range_of(chosen)
    if bounds:
        return segments.where(F.col(ordinal).between(*bounds))
    start, place = unused("_start", segments), unused("_place", segments)
    rows = segments
    if starts is not None:
        rows = rows.join(starts.select(item, F.col("start").alias(start)), item, "left").where(F.col(ordinal) >= F.coalesce(start, F.lit(1))).drop(start)
    else:
        rows = rows.where(F.col(ordinal) >= 1)
    return rows.withColumn(place, F.row_number().over(W.partitionBy(item).orderBy(ordinal))).where(F.col(place) <= max(1, limit)).drop(place)


def admitted(pending: DataFrame, active: DataFrame, most: int, *order: Column) -> DataFrame:
    """The first pending jobs, as many as ``most`` leaves room for beside the active ones; none if there is no room.

    Spark takes them as the top of a distributed order: each task passes on ``most`` rows at most.
    """
    n, room = unused("_n", pending), unused("_room", pending)
    top = pending.orderBy(*order).limit(most).withColumn(n, F.row_number().over(W.orderBy(*order)))
    free = active.agg((F.lit(most) - F.count("*")).alias(room))
    return top.join(F.broadcast(free), F.col(n) <= F.col(room)).drop(n, room)


def defaulted(df: DataFrame, chains: dict[str, list[str | Column]]) -> DataFrame:
    """Columns filled from the first of a chain that is neither null nor '': names of columns as they were before, or values."""
    filled = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")) if isinstance(c, str) else c
    return df.withColumns({name: F.coalesce(filled(name), *map(filled, chain)) if name in df.columns else F.coalesce(*map(filled, chain)) for name, chain in chains.items()})


def resolved(names: DataFrame, items: DataFrame, targets: DataFrame, segments: DataFrame, name: str, title: str) -> DataFrame:
    """``name, item, target, outcome, total`` for names of items that someone has given: what each stands for, and how much of it is ready.

    ``items`` has ``name, item, title`` (of equal names the least item counts), ``targets`` has ``title, target``, ``segments`` has ``item``.
    Outcomes: ``no_folder`` for an unknown name, ``no_target`` for a title without a target, else ``ready``; no text is compared, so ``total``
    counts the segments, and is 0 for the others.  One join each, however many names.
    """
    known = items.groupBy(name).agg(F.min_by(F.struct("item", title), "item").alias("i")).select(name, "i.*")
    aims = targets.groupBy(title).agg(F.min("target").alias("target"))
    rows = names.select(name).distinct().join(known, name, "left").join(aims, title, "left")
    counts = segments.groupBy("item").agg(F.count("*").alias("n"))
    outcome = F.when(F.col("item").isNull(), "no_folder").when(F.col("target").isNull(), "no_target").otherwise("ready")
    rows = rows.join(counts, "item", "left").withColumn("outcome", outcome)
    return rows.select(name, "item", "target", "outcome", F.when(F.col("outcome") == "ready", F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("total"))


def history_id(kind: str, folder: str | Column, state: Column, aliases: dict[str, str] | None = None) -> Column:
    """The id of an entry: ``<kind>-<folder>-<state>``, with some states under another name."""
    suffix = F
    for old, new in (aliases or {}).items():
        suffix = suffix.when(state == old, new)
    suffix = suffix.otherwise(state) if aliases else state
    return F.concat_ws("-", F.lit(kind), folder, suffix)


def marked(c: str, prefix: str, made: Column) -> Column:
    """Values that don't begin with the prefix yet, as ``made`` has them; others, and nulls, stay."""
    return F.when(~F.startswith(F.col(c), F.lit(prefix)), F.concat(F.lit(prefix), made)).otherwise(F.col(c))

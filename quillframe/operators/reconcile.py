"""Reconciling a library of source items with a target catalogue: who may be uploaded, updated, mended.

Each query is a chain of rules, and the first that fits decides.  The rules read columns that are
aggregated per item beforehand, so the plan is a few grouped joins and one ``CASE``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions.names import same_set
from quillframe.functions.text import collapse, strip


def first_rule(*rules: tuple[Column, str], otherwise: str) -> Column:
    """The outcome of the first rule that holds; a null condition doesn't."""
    out = F
    for test, outcome in rules:
        out = out.when(F.coalesce(test, F.lit(False)), outcome)
    return out.otherwise(otherwise)


def segment_facts(segments: DataFrame, item: str, ordinal: str, valid: str, name: str | None = None) -> DataFrame:
    """Per item: repeated ordinals, badly named files, first ordinal, number of segments, ordinals of well named ones.

    Repeats, the first ordinal and the number count every file with an ordinal; gaps only well named ones.
    """
    each = segments.groupBy(item, ordinal).agg(F.count("*").alias("_times"), F.bool_or(valid).alias("good"), F.count_if(~F.col(valid)).alias("bad"), *([F.array_sort(F.collect_list(F.when(~F.col(valid), F.col(name)))).alias("bad_names")] if name else []))
    facts = each.groupBy(item).agg(
        F.array_sort(F.collect_list(F.when((F.col("_times") > 1) & F.col(ordinal).isNotNull(), F.col(ordinal)))).alias("repeated"),
        F.sum("bad").alias("bad_files"),
        F.min(ordinal).alias("first"),
        F.sum(F.when(F.col(ordinal).isNotNull(), F.col("_times")).otherwise(0)).alias("segments"),
        F.array_sort(F.collect_list(F.when(F.col("good"), F.col(ordinal)))).alias("ordinals"),
        *([F.slice(F.array_sort(F.flatten(F.collect_list("bad_names"))), 1, 3).alias("bad_names")] if name else []),
    )
    return facts


def gaps(ordinals: Column) -> Column:
    """Ordinals missing between the first and the last, if there are two at least."""
    return F.when(F.size(ordinals) >= 2, F.array_except(F.sequence(F.array_min(ordinals), F.array_max(ordinals)), ordinals)).otherwise(F.slice(ordinals, 1, 0))


def upload_eligibility(items: DataFrame, targets: DataFrame, facts: DataFrame) -> DataFrame:
    """``item, outcome, missing`` of every source item.

    ``items`` has ``item, prefix, title`` (the key for matches) and ``valid_name``; ``targets`` has ``title``;
    ``facts`` is as ``segment_facts`` gives it.  Missing segments are a warning only.
    """
    done = items.where("prefix = 'DONE'")
    shared = done.groupBy("title").agg(F.count("*").alias("n")).where("n > 1").select("title", F.lit(True).alias("shared"))
    known = targets.select("title").distinct().withColumn("known", F.lit(True))
    rows = items.join(shared, "title", "left").join(known, "title", "left").join(facts, "item", "left")
    outcome = first_rule(
        (F.col("prefix") != "DONE", "not_ready"),
        (F.col("shared"), "invalid_title"),
        (F.col("known"), "already_on_server"),
        (~F.col("valid_name"), "invalid_source"),
        (F.size("repeated") > 0, "invalid_duplicate"),
        (F.col("bad_files") > 0, "invalid_filename"),
        (F.col("first") != 1, "invalid_first"),
        otherwise="uploadable",
    )
    return rows.select("item", outcome.alias("outcome"), F.when(outcome == "uploadable", F.coalesce(gaps(F.col("ordinals")), F.array().cast("array<int>"))).alias("missing"))


def _by_title(items: DataFrame, targets: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """``title, extended, others, known, top, wanted``: numbers of a title's items, its target's maximum, and whether it is wanted.

    One aggregation over all sides, with partial sums, so a title that very many items share costs no more than another.
    """
    none = {"extended": F.lit(0), "others": F.lit(0), "known": F.lit(False), "top": F.lit(None).cast(targets.schema["true_max"].dataType), "asked": F.lit(False)}
    side = lambda df, **own: df.select("title", *((own.get(n, c)).alias(n) for n, c in none.items()))
    is_extended = F.coalesce(F.col("prefix") == "EXTENDED", F.lit(False)).cast("int")
    rows = side(items, extended=is_extended, others=1 - is_extended).unionByName(side(targets, known=F.lit(True), top=F.col("true_max")))
    if wanted is not None:
        rows = rows.unionByName(side(wanted, asked=F.lit(True)))
    return rows.groupBy("title").agg(F.sum("extended").alias("extended"), F.sum("others").alias("others"), F.bool_or("known").alias("known"), F.max("top").alias("top"), F.bool_or("asked").alias("wanted"))


def _update_outcomes(rows: DataFrame, facts: DataFrame, rewritten: DataFrame | None) -> DataFrame:
    """``rows`` (``item, title, prefix, stray, shared, true_max``) with ``outcome`` and ``new_segments``."""
    rows = rows.join(facts, "item", "left")
    if rewritten is not None:
        rows = rows.join(rewritten.groupBy("item").agg(F.collect_set("ordinal").alias("rewritten")), "item", "left")
    else:
        rows = rows.withColumn("rewritten", F.array().cast("array<int>"))
    new = F.filter("ordinals", lambda n: n > F.col("true_max"))
    rows = rows.withColumn("new", new)
    outcome = first_rule(
        (F.col("shared"), "invalid_title"),
        (F.col("stray"), "wrong_prefix"),
        (F.col("true_max").isNull(), "no_server_match"),
        (F.size("repeated") > 0, "invalid_duplicate"),
        (F.col("bad_files") > 0, "invalid_filename"),
        (F.coalesce(F.col("segments"), F.lit(0)) == 0, "empty_extended"),
        (F.size("new") == 0, "no_update_needed"),
        (F.arrays_overlap("new", F.coalesce("rewritten", F.array().cast("array<int>"))), "invalid_rewritten"),
        (F.array_min("new") != F.col("true_max") + 1, "start_mid_series"),
        (F.size(gaps(F.col("new"))) > 0, "non_sequential"),
        otherwise="updatable",
    )
    return rows.withColumn("outcome", outcome).withColumn("new_segments", F.when(F.col("outcome") == "updatable", F.size("new")).otherwise(0))


def update_eligibility(items: DataFrame, targets: DataFrame, facts: DataFrame, rewritten: DataFrame | None = None) -> DataFrame:
    """``item, outcome, new_segments`` of the source items that may extend a target.

    ``items`` has ``item, prefix, title``; ``targets`` has ``title, true_max`` with unique titles.  Items with another
    prefix count only if their title is known and has no EXTENDED sibling.  ``rewritten`` holds
    ``item, ordinal`` of files that are marked as rewritten.
    """
    rows = items.select("item", "prefix", "title").join(_by_title(items, targets), "title", "left")
    extended = F.col("prefix") == "EXTENDED"
    rows = rows.where(F.coalesce(extended | (F.col("known") & (F.col("extended") == 0)), F.lit(False)))
    shared = F.when(F.col("extended") > 0, F.col("extended") > 1).otherwise(F.col("others") > 1)
    rows = rows.select("item", "title", "prefix", (~extended).alias("stray"), shared.alias("shared"), F.col("top").alias("true_max"))
    return _update_outcomes(rows, facts, rewritten).select("item", "outcome", "new_segments")


def finished_eligibility(items: DataFrame, targets: DataFrame, facts: DataFrame, finished: DataFrame, rewritten: DataFrame | None = None) -> DataFrame:
    """``title, item, outcome, new_segments`` of the series that readers have finished (``title``).

    Only EXTENDED items of these titles are judged, or items with another prefix where a title has no EXTENDED one; the
    rules are those of ``update_eligibility``.  An item without a target counts from 0.  A finished title with a target
    and without any such item has the outcome 'no_drive_folder' and no item.
    """
    wanted = finished.select("title").where("coalesce(cast(title as string), '') <> ''")
    titles = _by_title(items, targets, wanted).where("wanted")
    extended = F.col("prefix") == "EXTENDED"
    # A title without items stays, with nulls for one.
    rows = titles.join(items.select("item", "prefix", "title"), "title", "left")
    rows = rows.where(F.coalesce(extended, F.lit(False)) | (F.col("known") & (F.col("extended") == 0)))
    # Strays of one title are all of the wrong prefix; only EXTENDED ones can share a title.
    rows = rows.select("item", "title", "prefix", (~extended).alias("stray"), (extended & (F.col("extended") > 1)).alias("shared"), F.when(F.col("known"), F.col("top")).otherwise(0).alias("true_max"))
    judged = _update_outcomes(rows, facts, rewritten)
    lone = F.col("item").isNull()
    return judged.select("title", "item", F.when(lone, "no_drive_folder").otherwise(F.col("outcome")).alias("outcome"), F.when(lone, 0).otherwise(F.col("new_segments")).alias("new_segments"))


def metadata_differences(source: str, target: str) -> Column:
    """``array<(field, left, right)>`` of the fields in which two structs of metadata differ, in a fixed order.

    Both have ``main_category, sub_categories (list), free_count, push_title, push_content, synopsis, tags (list), max_chapter, length``.
    Categories (main and sub ones as one set) and tags are always compared, as sets whatever their case; another field only
    where the source has a value.  The target's maximum counts as 0 where it has none.
    """
    a, b = (lambda f: F.col(f"{source}.{f}")), (lambda f: F.col(f"{target}.{f}"))
    every = lambda x: F.concat(F.array(F.coalesce(x("main_category"), F.lit(""))), F.coalesce(x("sub_categories"), F.array().cast("array<string>")))
    key = lambda c: F.lower(collapse(F.coalesce(c.cast("string"), F.lit(""))))
    push = lambda x: F.concat(F.coalesce(x("push_title"), F.lit("")), F.lit("|"), F.coalesce(x("push_content"), F.lit("")))
    has_push = F.coalesce(F.nullif(a("push_title"), F.lit("")), a("push_content")).isNotNull()
    shown = lambda c: F.array_join(c, ",")
    tests = [
        ("category", ~same_set(every(a), every(b)), shown(every(a)), shown(every(b))),
        ("free_chapters_count", a("free_count").isNotNull() & ~a("free_count").eqNullSafe(F.coalesce(b("free_count"), F.lit(0))), a("free_count"), F.coalesce(b("free_count"), F.lit(0))),
        ("push", has_push & (key(push(a)) != key(push(b))), push(a), push(b)),
        ("synopsis", a("synopsis").isNotNull() & (key(a("synopsis")) != key(b("synopsis"))), a("synopsis"), b("synopsis")),
        ("tags", ~same_set(a("tags"), b("tags")), shown(F.coalesce(a("tags"), F.array().cast("array<string>"))), shown(F.coalesce(b("tags"), F.array().cast("array<string>")))),
        ("max_chapter", a("max_chapter").isNotNull() & ~a("max_chapter").eqNullSafe(F.coalesce(b("max_chapter"), F.lit(0))), a("max_chapter"), F.coalesce(b("max_chapter"), F.lit(0))),
        ("length", a("length").isNotNull() & (F.lower(strip(a("length"))) != F.lower(strip(F.coalesce(b("length"), F.lit(""))))), a("length"), b("length")),
    ]
    made = [F.when(test, F.struct(F.lit(name).alias("field"), left.cast("string").alias("left"), right.cast("string").alias("right"))) for name, test, left, right in tests]
    return F.array_compact(F.array(*made))


def metadata_reconciled(items: DataFrame, targets: DataFrame) -> DataFrame:
    """``item, outcome, differences``: can_update, all_match or no_server_match.

    ``items`` has ``item, title, source`` and ``targets`` has ``title, target``, the structs of ``metadata_differences``.
    """
    rows = items.join(targets, "title", "left").withColumn("differences", metadata_differences("source", "target"))
    outcome = first_rule((F.col("target").isNull(), "no_server_match"), (F.size("differences") > 0, "can_update"), otherwise="all_match")
    return rows.select("item", outcome.alias("outcome"), F.when(outcome == "can_update", F.col("differences")).alias("differences"))


def title_outcome(compared: DataFrame, item: str) -> DataFrame:
    """``item, outcome`` from a comparison of titles: can_update, all_match or empty_chapters."""
    per = compared.groupBy(item).agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("same", "different", "missing_right", "right_only")))
    outcome = first_rule((F.col("different") > 0, "can_update"), ((F.col("same") > 0) & (F.col("missing_right") == 0) & (F.col("right_only") == 0), "all_match"), otherwise="empty_chapters")
    return per.select(item, outcome.alias("outcome"))


def asset_outcome(has_file: Column, has_target: Column, last_state: Column) -> Column:
    """State of an asset such as a cover: no file comes before no target."""
    return first_rule((~has_file, "no_file"), (~has_target, "no_server_match"), (last_state == "updated", "updated"), otherwise="can_update")


def sync_plan(segments: DataFrame, maxima: DataFrame, item: str, ordinal: str, cap: int) -> DataFrame:
    """Segments to post: those after the target's last ordinal, or without one; ``cap`` per item at most, in order.

    ``maxima`` has ``item, true_max``; an item without a target counts from 0.
    """
    from quillframe.operators.tables import last_n

    rows = segments.join(maxima, item, "left").where(F.col(ordinal).isNull() | (F.col(ordinal) > F.coalesce("true_max", F.lit(0))))
    return last_n(rows.drop("true_max"), [item], cap, F.col(ordinal).asc_nulls_last(), F.col("segment"))

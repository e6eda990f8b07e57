"""Changing tables at rest.  Parquet has no row changes, so each of these makes the new image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillframe.operators.dedup import last_wins
from quillframe.operators.helpers import unused
from quillframe.sources.store import written

#: Spark's growing numbers have the task above this bit.
TASK_BIT = 33


def upserted(base: DataFrame, delta: DataFrame, keys: list[str], version: Column, keep_first: tuple[str, ...] = ()) -> DataFrame:
    """``base`` with the rows of ``delta`` inserted or put in place of those with equal keys.

    Of several delta rows for a key the one with the greatest ``version`` counts.  Columns in ``keep_first``
    keep the base's value, such as a time of creation.
    """
    new = last_wins(delta, keys, version)
    untouched = base.join(new.select(*keys), keys, "left_anti")
    if keep_first:
        before = {c: unused(f"_old_{c}", base, delta) for c in keep_first}
        old = base.select(*keys, *(F.col(c).alias(name) for c, name in before.items()))
        new = new.join(old, keys, "left").withColumns({c: F.coalesce(name, c) for c, name in before.items()}).drop(*before.values())
    return untouched.unionByName(new.select(*base.columns))


def change_feed(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, change`` (insert, update or delete) between two images with unique keys."""
    image = lambda df, name: df.select(*keys, F.to_json(F.struct(*(c for c in sorted(df.columns) if c not in keys)), {"ignoreNullFields": "false"}).alias(name))
    old, new = unused("_old", before, after), unused("_new", before, after)
    both = image(before, old).join(image(after, new), keys, "full")
    change = F.when(F.col(old).isNull(), "insert").when(F.col(new).isNull(), "delete").when(F.col(old) != F.col(new), "update")
    return both.select(*keys, change.alias("change")).where("change is not null")


def without_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def not_expired(df: DataFrame, state: str, terminal: list[str], time: str, cutoff: Column) -> DataFrame:
    """Without rows in a terminal state that were last changed before ``cutoff``; a null time stays."""
    return df.where(~F.coalesce(F.col(state).isin(terminal) & (F.col(time) < cutoff), F.lit(False)))


def capped(df: DataFrame, state: str, terminal: list[str], most: int, *order: Column) -> DataFrame:
    """Without the oldest terminal rows, so that ``most`` rows stay; active rows always stay.

    ``order`` ends in something unique, as in ``numbered``.
    """
    n, total = unused("_n", df), unused("_total", df)
    done = numbered(df.where(F.col(state).isin(terminal)), *order, name=n)
    done = done.join(F.broadcast(df.agg(F.count("*").alias(total))), F.col(n) > F.col(total) - most)
    return df.where(~F.coalesce(F.col(state).isin(terminal), F.lit(False))).unionByName(done.drop(n, total))


def numbered(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """Rows with their place (from 1) in the whole order, which must end in something unique.

    Spark draws the bounds of ranges from a sample of the whole order, not of its first column only; so rows that share a time, even a
    third of all, are dealt to ranges by what follows it, and tasks are of like size.  A row's place is the number of rows in the ranges before
    its own, a sum over one small row per range, plus its place within.  The ranges are written once, as both steps must see the same.
    """
    own, n, before, other = (unused(c, df) for c in ("_own", "_count", "_before", "_range"))
    # The upper bits of this number are those of the task, and tasks follow the ranges.
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(own, F.monotonically_increasing_id()))
    ranges = F.shiftright(own, TASK_BIT).alias(other)
    counts = rows.groupBy(ranges).agg(F.count("*").alias(n))
    counts = counts.select(other, (F.sum(n).over(W.orderBy(other).rowsBetween(W.unboundedPreceding, 0)) - F.col(n)).alias(before))
    inside = F.col(own).bitwiseAND((1 << TASK_BIT) - 1) + 1
    return rows.join(F.broadcast(counts), F.shiftright(own, TASK_BIT) == F.col(other)).withColumn(name, F.col(before) + inside).drop(own, before, other)


def last_n(df: DataFrame, keys: list[str], most: int, *order: Column) -> DataFrame:
    """The last ``most`` rows of each key; ``order`` descends."""
    n = unused("_n", df)
    return df.withColumn(n, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(n) <= most).drop(n)


def changes_only(df: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """Samples that differ from the one before them in some value; the first of each key stays."""
    w = W.partitionBy(*keys).orderBy(order)
    before = F.lag(F.struct(*values)).over(w)
    same = unused("_same", df)
    return df.withColumn(same, before.eqNullSafe(F.struct(*values)) & before.isNotNull()).where(~F.col(same)).drop(same)


def fingerprint(df: DataFrame) -> DataFrame:
    """``n, digest``: rows and an MD5 over sums of the rows' MD5s, whatever the rows' order.

    A row's text is its columns by name, null as a character that no text holds.  The four quarters of the rows' digests
    are added up as numbers, so nothing is collected, however many rows there are.
    """
    row = F.md5(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(df.columns))))
    parts = [F.sum(F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("decimal(20,0)")) for k in range(4)]
    sums = df.select(row.alias("h")).agg(F.count("*").alias("n"), *(F.coalesce(p, F.lit(0)).cast("string").alias(f"s{k}") for k, p in enumerate(parts)))
    return sums.select("n", F.md5(F.concat_ws(",", F.col("n").cast("string"), "s0", "s1", "s2", "s3")).alias("digest"))


def is_current(df: DataFrame, signature: str | None) -> DataFrame:
    """The table's fingerprint with ``current``: is an archive that was made under ``signature`` still that of the table?"""
    return fingerprint(df).withColumn("current", F.coalesce(F.col("digest") == F.lit(signature), F.lit(False)))


def write_replacing(df: DataFrame, path: str, partition: str) -> None:
    """Replaces the partitions that ``df`` has rows for; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def write_segments(df: DataFrame, path: str, form: str, group: str) -> None:
    """Segments as JSON lines, CSV with word counts, or Markdown texts: a folder per group with one file, by ordinal.

    ``df`` has ``group, ordinal, title, body``.  A group is one task's work, as it is one file.
    """
    from quillframe.functions.text import word_count

    df = df.repartition(group).sortWithinPartitions(group, "ordinal")
    if form == "json":
        df.write.mode("overwrite").partitionBy(group).json(path)
    elif form == "csv":
        df.withColumn("word_count", word_count("body")).write.mode("overwrite").partitionBy(group).option("header", True).option("escape", '"').csv(path)
    elif form == "md":
        text = F.concat(F.lit("Chapter "), F.col("ordinal").cast("string"), F.lit(": "), F.col("title"), F.lit("\n\n"), F.col("body"), F.lit("\n"))
        df.select(group, text.alias("value")).write.mode("overwrite").partitionBy(group).text(path)
    else:
        raise ValueError(f"no such form: {form}")


def fresh_inserts(base: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a batch whose keys are not there yet; a replay adds nothing."""
    return batch.join(base.select(*keys), keys, "left_anti")


def import_if_empty(target: DataFrame, source: DataFrame) -> DataFrame:
    """The source's rows if the target has none, else the target's."""
    return source.select(*target.columns) if target.isEmpty() else target


def probed(items: DataFrame, files: DataFrame, item: str, name: str, wanted: list[str]) -> DataFrame:
    """``items`` with a flag ``has_<name>`` for each wanted file name, in any case."""
    flags = files.groupBy(item).agg(*(F.bool_or(F.lower(name) == w.lower()).alias(f"has_{w}") for w in wanted))
    return items.join(flags, item, "left").fillna(False, [f"has_{w}" for w in wanted])


def retried(df: DataFrame, chosen: Column, priority: str, *order: Column) -> DataFrame:
    """Chosen rows get retry priorities above all others, the first in order the lowest; ``order`` as in ``numbered``."""
    n, top = unused("_n", df), unused("_top", df)
    highest = df.agg(F.coalesce(F.max(priority), F.lit(0)).alias(top))
    picked = numbered(df.where(chosen), *order, name=n)
    rest = df.where(~F.coalesce(chosen, F.lit(False)))
    return rest.unionByName(picked.join(F.broadcast(highest)).withColumn(priority, (F.col(top) + F.col(n)).cast(df.schema[priority].dataType)).drop(n, top))

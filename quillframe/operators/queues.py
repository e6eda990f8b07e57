"""Work queues: pages, claim order, priorities, buckets and recovery."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page(df: DataFrame, number: int, size: int, *order: Column, name: str = "total") -> DataFrame:
    """Rows of page ``number`` (from 1) with the total in the column ``name``; sizes are held between 1 and 500.

    The order must end in something unique.  Spark takes the page as the top of a distributed order.
    """
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"there is a column {name} already")
    size = max(1, min(500, size))
    total = df.agg(F.count("*").alias(name))
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size).crossJoin(F.broadcast(total))


def pages(total: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(total / size))


def by_ids(df: DataFrame, key: str, ids: list) -> DataFrame:
    """The rows with the given ids, in the order of these; unknown ids are left out."""
    wanted = df.sparkSession.createDataFrame(list(enumerate(ids)), f"pos int, {key} {df.schema[key].dataType.simpleString()}")
    return df.join(F.broadcast(wanted), key).orderBy("pos")


def claim(df: DataFrame, kind: str, created: str, index: str, key: str, later: str, blocked: tuple[str, ...] = (), n: int = 1) -> DataFrame:
    """The next ``n`` jobs: kind ``later`` last, then the oldest, by index (nulls last) and key; blocked kinds are passed over."""
    free = df.where(~F.coalesce(F.col(kind).isin(list(blocked)), F.lit(False))) if blocked else df
    return free.orderBy(F.when(F.col(kind) == later, 1).otherwise(0), F.col(created), F.col(index).asc_nulls_last(), F.col(key)).limit(n)


def prioritised(retry: str, category: str, order: list[str], index: str) -> list[Column]:
    """Sort keys: retried rows first, the highest retry first, then the rank of the category, then the index.

    A category outside ``order`` comes after all of these.
    """
    rank = F.array_position(F.array(*(F.lit(c) for c in order)).cast("array<string>"), F.col(category))
    rank = F.when(F.coalesce(rank, F.lit(0)) == 0, len(order)).otherwise(rank - 1)
    return [F.when(F.col(retry) > 0, 0).otherwise(1), -F.coalesce(F.col(retry), F.lit(0)), rank, F.col(index)]


def reordered(given: list[str], current: list[str]) -> list[str]:
    """Current categories: the given ones first, in the given order, then the others as they were."""
    first = [c for c in dict.fromkeys(given) if c in current]
    return first + [c for c in current if c not in first]


def bucket(position: Column, size: int) -> Column:
    """Number of the bucket (from 1) that holds a position (from 1), ``size`` to a bucket."""
    return (F.floor((position - 1) / size) + 1).cast("int")


def bucket_label(number: Column, width: int = 2) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def recovered(state: Column, retryable: Column, attempts: Column, most: int = 3) -> Column:
    """State of a job after a restart: what ran is queued again if it may be, else an error."""
    return F.when(state != "running", state).when(retryable & (attempts < most), "queued").otherwise("error")


def recovery_message(state: Column, retryable: Column, attempts: Column, most: int = 3) -> Column:
    return F.when((state == "running") & ~(retryable & (attempts < most)), F.when(attempts >= most, "Interrupted too often").otherwise("Interrupted by a restart"))


def searched(df: DataFrame, query: str, *columns: str) -> DataFrame:
    """Rows where some column holds the query, whatever its case."""
    return df.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(query.lower())))


def in_range(df: DataFrame, time: str, low: str | None, high: str | None, keep_null: bool) -> DataFrame:
    """Rows with a time from ``low`` to ``high``; rows without one are kept or not."""
    test = F.lit(True)
    if low is not None:
        test &= F.col(time) >= F.lit(low).cast("timestamp_ntz")
    if high is not None:
        test &= F.col(time) <= F.lit(high).cast("timestamp_ntz")
    return df.where(F.coalesce(test, F.lit(keep_null)) if (low or high) else F.lit(True))


# Ranks of states in lists of results.
STATE_RANK = {"running": 0, "completed": 1, "failed": 2, "cancelled": 3, "idle": 4}


def state_rank(state: Column) -> Column:
    """Running, completed, failed, cancelled, idle, then any other."""
    return F.coalesce(F.create_map(*(F.lit(x) for pair in STATE_RANK.items() for x in pair))[state], F.lit(99))


#: Groups of states by which jobs are listed.
STATE_GROUPS = {"failed": ["failed", "cancelled"], "running": ["running", "paused"]}


def of_state(df: DataFrame, state: str, wanted: str) -> DataFrame:
    return df if wanted == "all" else df.where(F.col(state) == wanted)


def of_group(df: DataFrame, state: str, group: str) -> DataFrame:
    """Rows of a group of states; a name that is no group is a state, and 'all' keeps everything."""
    return df if group == "all" else df.where(F.col(state).isin(STATE_GROUPS.get(group, [group])))


def among(df: DataFrame, **allowed: list | None) -> DataFrame:
    """Rows whose columns hold one of the allowed values each; no list means no condition."""
    for column, values in allowed.items():
        if values:
            df = df.where(F.col(column).isin(list(values)))
    return df


def owned(df: DataFrame, owner: str, user: object, everything: bool = False) -> DataFrame:
    """A user's own rows, or all of them for a role that may see everything."""
    return df if everything else df.where(F.col(owner) == F.lit(user))


def selected_first(selected: Column, *order: Column) -> list[Column]:
    """Sort keys: selected rows first, then the given order; null counts as not selected."""
    return [F.when(F.coalesce(selected, F.lit(False)), 0).otherwise(1), *order]


def whitelisted(items: Column, allowed: list[str]) -> Column:
    """The allowed ones among the distinct items, in their order; all allowed ones where none is given."""
    every = F.array(*(F.lit(a) for a in allowed)).cast("array<string>")
    given = F.array_intersect(F.coalesce(items, F.array().cast("array<string>")), every)
    return F.when(F.size(given) > 0, given).otherwise(every)


def discovered(df: DataFrame, keyword: str | None = None, text: tuple[str, ...] = (), categories: tuple[str, Iterable | DataFrame] | None = None, status: tuple[str, str] | None = None, least: tuple[str, int] | None = None, since: tuple[str, Column] | None = None) -> DataFrame:
    """Catalogue search: every condition that is given must hold.

    ``categories``, ``status`` ('all' is no condition), ``least`` and ``since`` name their column first.  Categories may be a table
    with that column; then none of them is no category.
    """
    if keyword:
        df = searched(df, keyword, *text)
    if categories and isinstance(categories[1], DataFrame):
        df = df.join(categories[1].select(categories[0]), categories[0], "left_semi")
    elif categories and list(categories[1]):
        df = df.where(F.col(categories[0]).isin(list(categories[1])))
    if status and status[1] != "all":
        df = df.where(F.col(status[0]) == status[1])
    if least:
        df = df.where(F.col(least[0]) >= least[1])
    if since:
        df = df.where(F.col(since[0]) >= since[1])
    return df

"""Which row of a key stays: the conflict policies.

Every policy takes an explicit order, as rows of a table have none, and works as one grouped
aggregation with partial sums on the map side (``min_by`` over a struct), never as a window over
whole groups; so a key with a third of all rows costs no more than another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: list[str], order: list[Column], smallest: bool) -> DataFrame:
    """One whole row per key: that with the least or greatest order; nulls of the order count as lowest."""
    rank = F.struct(*(c.alias(f"r{k}") for k, c in enumerate(order)))
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    chosen = (F.min_by if smallest else F.max_by)(row, rank)
    return df.groupBy(*keys).agg(chosen.alias("_row")).select("_row.*")


def first_wins(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key; ``order`` must end in something unique."""
    return _pick(df, keys, list(order), True)


def last_wins(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key."""
    return _pick(df, keys, list(order), False)


def rank_wins(df: DataFrame, keys: list[str], state: str, ranking: list[str], *order: Column) -> DataFrame:
    """The row with the highest-ranked state (the first of ``ranking``), the first in order among equals.

    A state outside the ranking comes last.
    """
    rank = F.array_position(F.array(*(F.lit(s) for s in ranking)), F.col(state))
    rank = F.coalesce(F.nullif(rank, F.lit(0)), F.lit(len(ranking) + 1))
    return _pick(df, keys, [rank, *order], True)


def best_score(df: DataFrame, keys: list[str], score: str, *order: Column) -> DataFrame:
    """The row with the greatest score, the first in order among equals; a null score comes last."""
    return _pick(df, keys, [F.when(F.col(score).isNull(), 1).otherwise(0), -F.coalesce(F.col(score).cast("double"), F.lit(0.0)), *order], True)


def unless_placeholder(df: DataFrame, keys: list[str], placeholder: Column, *order: Column) -> DataFrame:
    """The first row that is no placeholder; the first one where all are."""
    return _pick(df, keys, [placeholder.cast("int"), *order], True)


def key_or_position(key: str, position: str) -> Column:
    """A key that falls back to the row's position where it is null or ''."""
    return F.coalesce(F.nullif(F.col(key).cast("string"), F.lit("")), F.concat(F.lit("index:"), F.col(position).cast("string")))


def merged(old: DataFrame, new: DataFrame, key: str, replaced: list[str]) -> DataFrame:
    """Old rows with the new ones on top; ``is_new`` marks keys that were not there.

    A new row replaces all of ``replaced``, nulls included; other columns keep the old values.
    """
    before = old.select(F.col(key).alias("_old_key"), *(F.col(c).alias(f"_old_{c}") for c in old.columns if c != key))
    both = before.join(new, F.col("_old_key") == F.col(key), "full")
    kept = []
    for c in old.columns:
        if c == key:
            kept.append(F.coalesce(F.col(key), F.col("_old_key")).alias(key))
        elif c in replaced:
            kept.append(F.when(F.col(key).isNotNull(), F.col(c)).otherwise(F.col(f"_old_{c}")).alias(c))
        else:
            kept.append(F.coalesce(F.col(f"_old_{c}"), *([F.col(c)] if c in new.columns else [])).alias(c))
    return both.select(*kept, (F.col("_old_key").isNull() & F.col(key).isNotNull()).alias("is_new"))


def latest(df: DataFrame, keys: list[str], time: str, *order: Column) -> DataFrame:
    """The latest row of each key; a null time comes first, ties go by ``order``."""
    return _pick(df, keys, [F.col(time), *order], False)

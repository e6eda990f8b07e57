"""Finding titles that are alike through an index of letter pairs, instead of comparing every pair of titles.

If two keys have the likeness ``r = 2 * M / (m + n)`` by matching blocks, then ``m + n - 2 * M`` insertions and deletions turn one into
the other, and each of these takes at most two of the letter pairs (grams) of a key away.  So of keys with a likeness of ``least`` or
more each must share a gram among its ``2 * D + 1`` rarest with the other's, where ``D`` is the most edits that a key of its length can
need.  Only these are posted and joined, only between keys of like length, and pairs whose letters in common allow
``least`` are compared.  Keys of very few different grams could lose all of them; they are posted under a gram of their own as well.

Names of one template ("customer 000012345") share all their grams with very many others.  Where only the best name is asked for, keys
that few edits turn one into the other are found first: they become the same string without a letter or two, whatever the others are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillframe.functions.text import title_key_words
from quillframe.functions.unicode import most_alike_in_blocks, ratio, unescape
from quillframe.sources.store import written

GRAM = 2
#: Stands for keys that may share no gram with one that is like them.
BARE = "\x00"
#: Below this the index would hold nearly all grams of a key.
LOWEST = 0.8
#: Edits up to which the best name is sought by leaving letters out; the second only for keys of so many letters, as their pairs count.
EDITS, SHORT = 2, 24
#: So few queries are not worth the second edit; the index answers them.
FEW = 1000


def _keys(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column), title_key_words(unescape(F.coalesce(F.col(column), F.lit("")))).alias("key"))


def _grams(key: Column) -> Column:
    """The different letter pairs of a key, with a mark at both of its ends."""
    marked = F.concat(F.lit("\x01"), key, F.lit("\x02"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(key) + 1), lambda k: F.substring(marked, k, F.lit(GRAM))))


def _posted(keys: DataFrame, counts: DataFrame, least: float) -> DataFrame:
    """``(key, gram)``: the rarest grams of each key that one like it can't lack; grams without a count are the rarest."""
    edits = F.floor(F.length("key") * (2 * (1 - least) / least) + 1e-9)
    rows = keys.select("key", F.explode(_grams(F.col("key"))).alias("gram")).join(counts, "gram", "left")
    held = rows.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("held"))
    held = held.select("key", F.transform(F.slice("held", F.lit(1), (GRAM * edits + 1).cast("int")), lambda x: x["gram"]).alias("first"), (F.size("held") <= GRAM * edits).alias("bare"))
    return held.select("key", F.explode(F.when(F.col("bare"), F.array_append("first", F.lit(BARE))).otherwise(F.col("first"))).alias("gram"))


def candidates(asked: DataFrame, names: DataFrame, least: float) -> DataFrame:
    """``(a, b)``: pairs of a key of ``asked`` and one of ``names`` (each ``key``, distinct and not empty) that the index lets through."""
    counts = names.select(F.explode(_grams(F.col("key"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    one, two = (_posted(df, counts, least).withColumnRenamed("key", c) for df, c in ((asked, "a"), (names, "b")))
    # The shorter key bounds what can match.
    sized = least * (F.length("a") + F.length("b")) <= 2 * F.least(F.length("a"), F.length("b")) + 1e-9
    pairs = one.join(two, "gram").where(sized).select("a", "b").distinct()
    common = F.aggregate(F.array_distinct(F.split("a", "")), F.lit(0), lambda n, x: n + F.least(_count("a", x), _count("b", x)))
    return pairs.where(least * (F.length("a") + F.length("b")) <= 2 * common + 1e-9)


def _count(column: str, letter: Column) -> Column:
    return F.length(column) - F.length(F.replace(F.col(column), letter, F.lit("")))


def alike(asked: DataFrame, names: DataFrame, least: float = 0.96) -> DataFrame:
    """``query, name, score``: all pairs with a likeness of ``least`` (0.8 or more), by ``title_likeness``.

    ``asked`` has distinct ``query``, ``names`` distinct ``name``.  Titles with equal keys are compared once.  A null or empty key is like nothing.
    """
    if least < LOWEST:
        raise ValueError(f"the index needs a likeness of {LOWEST} or more")
    asked, names = (written(_keys(df, c)) for df, c in ((asked, "query"), (names, "name")))
    one, two = (df.where("key <> ''").select("key").distinct() for df in (asked, names))
    equal = one.join(two, "key").select(F.col("key").alias("a"), F.col("key").alias("b"), F.lit(1.0).alias("score"))
    other = candidates(one, two, least).where("a <> b").withColumn("score", ratio("a", "b")).where(F.col("score") >= least)
    found = equal.unionByName(other)
    found = asked.withColumnRenamed("key", "a").join(found, "a").join(names.withColumnRenamed("key", "b"), "b")
    return found.select("query", "name", "score")


def _without(keys: DataFrame, letters: int, out: str) -> DataFrame:
    """``at, out``: each key under a hash of every string that it becomes without so many of its letters."""
    made = F.array("key")
    for _ in range(letters):
        less = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda k: F.concat(F.substring(s, F.lit(1), k - 1), F.substring(s, k + 1, F.length(s))))
        made = F.array_distinct(F.flatten(F.transform(made, less)))
    return keys.where(F.length("key") >= letters).select(F.explode(F.transform(made, lambda s: F.xxhash64(s))).alias("at"), F.col("key").alias(out))


def edited(asked: DataFrame, names: DataFrame, edits: int) -> DataFrame:
    """``(a, b)``: pairs of a ``key`` of each side that so many insertions and deletions turn one into the other, and few others."""
    # Spark takes the strings of a key for one row, so it would broadcast them.
    sides = [_without(asked, n, "a").join(_without(names, edits - n, "b").hint("merge"), "at").select("a", "b") for n in range(edits + 1)]
    return reduce(DataFrame.unionByName, sides).distinct()


def accepted(asked: DataFrame, names: DataFrame, least: float = 0.96) -> DataFrame:
    """``query, name, score``: the best name of each query, if it is good enough to be taken; of equal scores the first name.

    With ``e`` edits a key of ``m`` letters has a likeness of ``2 * m / (2 * m + e)`` at most.  So a query is settled once its best name
    is better than one more edit allows, or once that is below ``least``.  Only the rest are sought through the index.
    """
    if least < LOWEST:
        raise ValueError(f"the index needs a likeness of {LOWEST} or more")
    asked = written(_keys(asked, "query").where("key <> ''"))
    # Of names with equal keys only the first can be taken.
    names = written(_keys(names, "name").where("key <> ''").groupBy("key").agg(F.min("name").alias("name")))
    keys, left = names.select("key"), written(asked.select("key").distinct())
    best, settled = left.select(F.col("key").alias("a"), F.lit("").alias("name"), F.lit(0.0).alias("score")).limit(0), []

    def better(best: DataFrame, pairs: DataFrame) -> DataFrame:
        scored = pairs.withColumn("score", F.when(F.col("a") == F.col("b"), 1.0).otherwise(ratio("a", "b"))).where(F.col("score") >= least)
        found = scored.join(names.withColumnRenamed("key", "b"), "b").select("a", "name", "score").unionByName(best)
        return found.groupBy("a").agg(F.min_by(F.struct("name", "score"), F.struct(-F.col("score"), F.col("name"))).alias("best")).select("a", "best.*")

    for edits in range(EDITS + 1):
        tried = left.where(F.length("key") <= SHORT) if edits > 1 else left
        n = tried.count()
        if not n or edits > 1 and n <= FEW:
            break
        best = written(better(best, edited(tried, keys, edits)))
        allowed = 2 * F.length("key") / (2 * F.length("key") + edits + 1)
        done = tried.join(best.withColumnRenamed("a", "key"), "key", "left").where((F.col("score") > allowed + 1e-9) | (allowed < least - 1e-9))
        done = written(done.select("key", "name", "score"))
        settled.append(done.where("name is not null"))
        left = written(left.join(done, "key", "left_anti"))
        best = best.join(left.withColumnRenamed("key", "a"), "a", "left_semi")
    if not left.isEmpty():
        settled.append(better(best, candidates(left, keys, least)).withColumnRenamed("a", "key"))
    return asked.join(reduce(DataFrame.unionByName, settled), "key").select("query", "name", "score")


def most_alike(asked: DataFrame, names: DataFrame, keep: int = 3, levels: tuple[float, ...] = (0.96, 0.9)) -> DataFrame:
    """``name, query, score, r``: the ``keep`` names most like each ``query``, of equal scores the first in order.

    Queries with ``keep`` names above a level are answered by the index at that level, which then holds all of their best.  Only the rest
    go on to the next level, and what no level answers is compared with all names, block by block, by falling bounds.
    """
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "name"))
    answers, left = [], written(asked.select("query"))
    for least in levels:
        found = written(alike(left, names, least))
        done = written(found.groupBy("query").count().where(F.col("count") >= keep).select("query"))
        answers.append(found.join(done, "query", "left_semi").withColumn("r", place).where(F.col("r") <= keep).select("name", "query", "score", "r"))
        left = written(left.join(done, "query", "left_anti"))
    out = most_alike_in_blocks(left, names, keep)
    for part in answers:
        out = out.unionByName(part)
    return out

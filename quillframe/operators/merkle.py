"""A tree of digests over a table, and an archive of the table of which only changed parts are made again.

Rows are dealt to 256 parts by their keys.  A part's digest is that of its rows whatever their order, and a node's that of its children,
up to one digest for the whole; so two tables are compared from the top, and an archive knows the parts that differ.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.operators.helpers import unused
from quillframe.sources.store import Store

#: Hexadecimal digits of a key's MD5 that name its part.
DIGITS = 2


def part_of(*keys: str) -> Column:
    """The part of a row: the first digits of an MD5 of its keys; null as a character that no text holds."""
    return F.substring(F.md5(F.concat_ws("\x1f", *(F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys))), 1, DIGITS)


def leaves(df: DataFrame, keys: list[str]) -> DataFrame:
    """``node, n, digest`` of each part that has rows; sums of rows' digests, with partial sums in each task."""
    row = F.md5(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(df.columns))))
    parts = [F.sum(F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("decimal(20,0)")).cast("string").alias(f"s{k}") for k in range(4)]
    sums = df.select(part_of(*keys).alias("node"), row.alias("h")).groupBy("node").agg(F.count("*").alias("n"), *parts)
    return sums.select("node", "n", F.md5(F.concat_ws(",", F.col("n").cast("string"), "s0", "s1", "s2", "s3")).alias("digest"))


def tree(found: DataFrame) -> DataFrame:
    """``node, n, digest`` of all nodes above and with the leaves; the root's name is ''.  An empty table has no nodes."""
    out = level = found
    for size in reversed(range(DIGITS)):
        children = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda x: x["digest"]), ",")
        level = level.groupBy(F.substring("node", 1, size).alias("up")).agg(F.sum("n").alias("n"), F.md5(children).alias("digest")).withColumnRenamed("up", "node")
        out = out.unionByName(level)
    return out


class Archive:
    """A copy of a table below ``path`` in parts, with the digests of these."""

    def __init__(self, df: DataFrame, path: str, keys: list[str]):
        self.df, self.path, self.keys = df, path.rstrip("/"), keys
        self.spark, self.store = df.sparkSession, Store(df.sparkSession, path)

    def _known(self) -> dict[str, str]:
        """Digests by part as of the last whole refresh; at most 256 rows."""
        names = [n for n in self.store.names() if n.startswith("digests-")]
        return {r["node"]: r["digest"] for n in names[-1:] for r in self.spark.read.parquet(f"{self.path}/{n}").collect()}

    def refresh(self) -> list[str]:
        """Makes the parts again whose digests have changed, drops those without rows, and returns their names.

        The digests are written last, so a refresh that was cut off is done again.
        """
        now = leaves(self.df, self.keys)
        fresh = {r["node"]: r["digest"] for r in now.select("node", "digest").collect()}
        known = self._known()
        stale = sorted(n for n, d in fresh.items() if known.get(n) != d)
        gone = sorted(known.keys() - fresh.keys())
        column = unused("part", self.df)
        if stale:
            rows = self.df.withColumn(column, part_of(*self.keys)).where(F.col(column).isin(stale))
            rows.repartition(column).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(f"{self.path}/data")
        for n in gone:
            self.store.delete(f"data/{column}={n}")
        if stale or gone:
            before = [n for n in self.store.names() if n.startswith("digests-")]
            number = int(before[-1].split("-")[1]) + 1 if before else 0
            kept = self.spark.createDataFrame(sorted(fresh.items()), "node string, digest string")
            name = f"writing-{uuid.uuid4().hex}"
            kept.coalesce(1).write.parquet(f"{self.path}/{name}")
            self.store.rename(name, f"digests-{number:08d}")
            for n in before:
                self.store.delete(n)
        return stale + gone

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.df.schema).parquet(f"{self.path}/data").select(*self.df.columns)

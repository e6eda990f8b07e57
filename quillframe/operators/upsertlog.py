"""A table at rest that takes upserts and deletes in small steps.

Rows are dealt to buckets by a hash of their keys.  A batch adds one folder, ``data/step=<n>/bucket=<b>``, for each bucket that it
touches, with the last row of each key; nothing that is there is written again, so a batch costs what it holds.  A
manifest, ``manifests/<n>.json``, names the steps of each bucket that make up the table, and is published by one rename: a
reader sees a batch whole or not at all, and a batch that comes again finds its number in the manifest and adds nothing.

Readers merge the steps of a bucket; a bucket of one step is read as it is, without a shuffle.  ``compact`` merges, bucket by
bucket, the newest steps up to one that is more than ``ratio`` times as large as they are together.  So a bucket has
a number of steps that grows with the logarithm of its size, and a row is written again as often.

Merging is associative: of a key's rows the one with the greatest version counts, of equal ones that of the later batch; columns of
``keep_first`` come from the row with the least.  So compaction changes no result, and rows that come late change nothing newer.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.sources.store import Store

#: Columns that the table adds: is the key deleted, and the order of the row that its first values come from.
DELETED, SINCE, SINCE_STEP = "_deleted", "_since", "_since_step"
OWN = [DELETED, SINCE, SINCE_STEP, "step", "bucket"]


class UpsertLog:
    """A table below ``path``; keys, version, ``keep_first`` and buckets are those that it was made with.

    A null in a key is a value like any other, and a null version comes before all others.  Names that the table adds itself
    (``_deleted, _since, _since_step, step, bucket``) can't be columns.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.store = spark, path.rstrip("/"), Store(spark, path)

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], version: str, keep_first: tuple[str, ...] = (), buckets: int = 16) -> UpsertLog:
        """A new table without rows, or the one that is there already."""
        log = cls(spark, path)
        if log._versions():
            return log
        taken = {c.lower() for c in schema.names} & set(OWN)
        if taken:
            raise ValueError(f"names of the table's own: {sorted(taken)}")
        made = {"schema": schema.jsonValue(), "keys": keys, "version": version, "keep_first": list(keep_first), "buckets": buckets, "batch": -1, "live": {}}
        log.store.publish("manifests/00000000.json", json.dumps(made))
        return log

    def _versions(self) -> list[str]:
        return [n for n in self.store.names("manifests") if n.endswith(".json")]

    def manifest(self) -> tuple[int, dict]:
        """The number and the content of the newest manifest."""
        last = self._versions()[-1]
        return int(last.removesuffix(".json")), json.loads(self.store.text(f"manifests/{last}"))

    def _order(self, now: dict, version: str = "", step: str = "step") -> F.Column:
        return F.struct(F.col(version or now["version"]), F.col(step))

    def _last(self, rows: DataFrame, now: dict) -> DataFrame:
        """One row per key, in the columns of the files; a grouped aggregation with partial sums, whatever a key's rows."""
        columns = T.StructType.fromJson(now["schema"]).names
        first = F.min_by(F.struct(SINCE, SINCE_STEP, *now["keep_first"]), self._order(now, SINCE, SINCE_STEP)).alias("_first")
        last = F.max_by(F.struct(*columns, DELETED), self._order(now)).alias("_last")
        found = rows.groupBy("bucket", *(F.col(k).alias(f"_key_{i}") for i, k in enumerate(now["keys"]))).agg(first, last)
        kept = [F.col(f"_first.{c}").alias(c) if c in now["keep_first"] else F.col(f"_last.{c}").alias(c) for c in columns]
        return found.select(*kept, f"_last.{DELETED}", f"_first.{SINCE}", f"_first.{SINCE_STEP}", "bucket")

    def _write(self, rows: DataFrame, step: int) -> dict[str, int]:
        """Writes a step; bytes by bucket.  What an earlier attempt has left is replaced."""
        place = f"data/step={step}"
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{place}")
        return {n.removeprefix("bucket="): self.store.bytes_in(f"{place}/{n}") for n in self.store.names(place) if n.startswith("bucket=")}

    def append(self, batch: DataFrame, number: int, deleted: F.Column | None = None) -> bool:
        """Upserts the rows of a batch, and deletes the keys of those for which ``deleted`` is true; False if it was there already.

        Numbers of batches rise.
        """
        step, now = self.manifest()
        if number <= now["batch"]:
            return False
        step += 1
        columns = T.StructType.fromJson(now["schema"])
        bucket = F.pmod(F.xxhash64(*now["keys"]), F.lit(now["buckets"])).cast("int")
        gone = F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)
        rows = batch.withColumn(DELETED, gone).select(*(F.col(f.name).cast(f.dataType) for f in columns), DELETED, F.lit(step).alias("step"))
        rows = rows.withColumns({SINCE: F.col(now["version"]), SINCE_STEP: F.col("step"), "bucket": bucket})
        for name, size in self._write(self._last(rows, now), step).items():
            now["live"].setdefault(name, []).append([step, size])
        self._publish(step, now | {"batch": number})
        return True

    def _publish(self, step: int, now: dict) -> None:
        self.store.publish(f"manifests/{step:08d}.json", json.dumps(now))

    def _files(self, now: dict, parts: list[tuple[str, int]]) -> DataFrame:
        fields = T.StructType.fromJson(now["schema"])
        version = fields[now["version"]].dataType
        own = [(DELETED, T.BooleanType()), (SINCE, version), (SINCE_STEP, T.IntegerType()), ("step", T.IntegerType()), ("bucket", T.IntegerType())]
        schema = T.StructType([*fields, *(T.StructField(n, t) for n, t in own)])
        if not parts:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/data/step={step}/bucket={name}" for name, step in parts]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        """The table's rows, as of its newest manifest or of an older one that is still there."""
        now = self.manifest()[1] if version is None else json.loads(self.store.text(f"manifests/{version:08d}.json"))
        single = [(name, steps[0][0]) for name, steps in now["live"].items() if len(steps) == 1]
        several = [(name, step) for name, steps in now["live"].items() if len(steps) > 1 for step, _ in steps]
        columns = T.StructType.fromJson(now["schema"]).names
        out = self._files(now, single).select(*columns, DELETED)
        if several:
            out = out.unionByName(self._last(self._files(now, several), now).select(*columns, DELETED))
        return out.where(~F.col(DELETED)).drop(DELETED)

    def compact(self, ratio: float = 2.0) -> int:
        """Merges the newest steps of each bucket while that pays; the number of buckets that were written.

        Deleted keys stay as marks, so that rows that come late don't bring them back.
        """
        step, now = self.manifest()
        chosen: dict[str, int] = {}
        for name, steps in now["live"].items():
            total, first = steps[-1][1], len(steps) - 1
            while first and steps[first - 1][1] <= ratio * total:
                first -= 1
                total += steps[first][1]
            if first < len(steps) - 1:
                chosen[name] = first
        if not chosen:
            return 0
        parts = [(name, s) for name, first in chosen.items() for s, _ in now["live"][name][first:]]
        sizes = self._write(self._last(self._files(now, parts), now), step + 1)
        for name, first in chosen.items():
            now["live"][name] = [*now["live"][name][:first], [step + 1, sizes[name]]]
        self._publish(step + 1, now)
        return len(chosen)

    def vacuum(self, keep: int = 2) -> None:
        """Deletes all but the newest ``keep`` manifests, and the steps that these don't name."""
        names = self._versions()
        old, kept = names[:-keep], names[-keep:]
        used = {(b, s) for n in kept for b, steps in json.loads(self.store.text(f"manifests/{n}"))["live"].items() for s, _ in steps}
        newest = int(names[-1].removesuffix(".json"))
        for n in old:
            self.store.delete(f"manifests/{n}")
        for folder in self.store.names("data"):
            step = int(folder.removeprefix("step="))
            buckets = [b for b in self.store.names(f"data/{folder}") if b.startswith("bucket=")]
            live = [b for b in buckets if (b.removeprefix("bucket="), step) in used]
            # A step beyond the newest manifest is being written.
            if step <= newest and not live:
                self.store.delete(f"data/{folder}")
            elif step <= newest:
                for b in set(buckets) - set(live):
                    self.store.delete(f"data/{folder}/{b}")

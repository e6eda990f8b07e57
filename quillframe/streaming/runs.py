"""Streaming forms: tailing run logs, limits, spells of activity, checkpoints of discovery."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillframe.functions.values import log_event
from quillframe.operators.upsertlog import UpsertLog


def tail(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of what is added to a folder of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(path)


def distinct_lines(stream: DataFrame, at: str, message: str, delay: str = "10 minutes") -> DataFrame:
    """Each (time, message) once, as long as it comes within the delay."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp"))
    return timed.withWatermark(at, delay).dropDuplicatesWithinWatermark([at, message])


def progress(stream: DataFrame, run: str, line: str) -> DataFrame:
    """Running counters per run from its log lines: segments, errors, the largest total."""
    event = log_event(line)
    return stream.withColumn("e", event).groupBy(run).agg(
        F.count_if(F.col("e.kind") == "segment").alias("segments"),
        F.count_if(F.col("e.kind") == "error").alias("errors"),
        F.max("e.total").alias("total"),
    )


def windowed_counts(stream: DataFrame, at: str, kind: str, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Events per kind and window; late ones count while the delay lasts."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp"))
    return timed.withWatermark(at, delay).groupBy(F.window(at, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def spells(stream: DataFrame, key: str, at: str, gap: str, delay: str = "1 day") -> DataFrame:
    """Spells of activity per key as sessions: ended by ``gap`` without an event."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp"))
    return timed.withWatermark(at, delay).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("started"), "n")


def limited(stream: DataFrame, key: str, at: str, limit: int, window: float) -> DataFrame:
    """``key, at, accepted`` under a sliding limit; ``at`` is in seconds.  State per key: at most ``limit`` times."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        times = sorted(t for pdf in batches for t in pdf[at])
        out = []
        for t in times:
            held = [x for x in held if t - x < window]
            ok = len(held) < limit
            if ok:
                held.append(t)
            out.append((group[0], t, ok))
        state.update((held,))
        yield pd.DataFrame(out, columns=[key, at, "accepted"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.select(key, F.col(at).cast("double").alias(at)).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {at} double, accepted boolean", "held array<double>", "append", GroupStateTimeout.NoTimeout)


def terminal(stream: DataFrame, run: str, at: str, state_column: str, final: list[str], idle: str) -> DataFrame:
    """One row per run when it reaches a final state, or when nothing has come from it for ``idle``.

    Times out by event time, behind a watermark of ten minutes.
    """

    seconds = pd.Timedelta(idle).total_seconds()

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, done = state.get
            state.remove()
            yield pd.DataFrame([(group[0], "timed_out", pd.Timestamp(last, unit="us"))] if not done else [], columns=[run, "outcome", "ended"])
            return
        last, done = state.get if state.exists else (0, False)
        out = []
        for pdf in batches:
            for t, s in sorted(zip(pdf[at], pdf[state_column], strict=True)):
                last = max(last, int(t.value // 1000))
                if s in final and not done:
                    done = True
                    out.append((group[0], s, t))
        state.update((last, done))
        state.setTimeoutTimestamp(max(last // 1000 + int(seconds * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[run, "outcome", "ended"])

    kind = stream.schema[run].dataType.simpleString()
    timed = stream.select(run, F.col(at).cast("timestamp").alias(at), state_column).withWatermark(at, "10 minutes")
    return timed.groupBy(run).applyInPandasWithState(step, f"{run} {kind}, outcome string, ended timestamp", "last long, done boolean", "append", GroupStateTimeout.EventTimeTimeout)


def discovery(pages: DataFrame, category: str, page: str, finished: Column) -> DataFrame:
    """Checkpoint of discovery per category: the last page seen and whether its end was ever reached."""
    return pages.groupBy(category).agg(F.max(page).alias("page"), F.bool_or(finished).alias("terminal"))


def resumed(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is left to do after a checkpoint."""
    return work.join(done.select(key), key, "left_anti")


def upsert_sink(path: str, keys: list[str], version: str, buckets: int = 16):
    """A ``foreachBatch`` function that keeps the latest row per key, of all batches, in an ``UpsertLog``.

    A batch writes what it holds, and now and then merges small steps; one that is replayed adds nothing.
    ``latest_image`` reads the table.
    """

    def write(batch: DataFrame, number: int) -> None:
        log = UpsertLog.create(batch.sparkSession, path, batch.schema, keys, version, buckets=buckets)
        if log.append(batch, number):
            log.compact()
            log.vacuum(keep=8)

    return write


def latest_image(spark: SparkSession, path: str) -> DataFrame:
    """The table of ``upsert_sink`` after its last whole batch."""
    return UpsertLog(spark, path).read()


def changes(rows: DataFrame, run: str, cursor: str, state_column: str, final: list[str], after: Column) -> DataFrame:
    """What a reader with a cursor has not seen: lines beyond it, with ``terminal`` on each run's first line in a final state.

    Lines after that one are left out.  ``rows`` is a table or the part of a stream's batch; ``after`` may differ by run.
    """
    ended = F.min(F.when(F.col(state_column).isin(final), F.col(cursor))).over(W.partitionBy(run))
    seen = rows.withColumn("terminal", ended)
    seen = seen.where(F.col("terminal").isNull() | (F.col(cursor) <= F.col("terminal")))
    return seen.withColumn("terminal", F.coalesce(F.col(cursor) == F.col("terminal"), F.lit(False))).where(F.col(cursor) > after)


def timeouts(events: DataFrame, run: str, at: str, now: Column, idle: float, most: float) -> DataFrame:
    """``run, outcome, ended`` of runs that stood still for ``idle`` seconds, or lasted ``most``; the earlier one counts.

    ``at`` is in seconds.  A run that did neither by ``now`` has the outcome 'running' and no end.
    """
    w = W.partitionBy(run).orderBy(at)
    rows = events.select(run, F.col(at).cast("double").alias("at"), F.coalesce(F.lead(at).over(w), now).cast("double").alias("next"))
    per = rows.groupBy(run).agg(F.min("at").alias("begun"), F.min(F.when(F.col("next") - F.col("at") > idle, F.col("at") + idle)).alias("idle_at"), F.max("next").alias("last"))
    whole = F.when(F.greatest(F.col("last"), now.cast("double")) - F.col("begun") > most, F.col("begun") + most)
    ended = F.least("idle_at", whole)
    outcome = F.when(ended.isNull(), "running").when(F.coalesce(F.col("idle_at"), F.lit(float("inf"))) <= F.coalesce(whole, F.lit(float("inf"))), "idle").otherwise("too_long")
    return per.select(run, outcome.alias("outcome"), ended.alias("ended"))

"""A change feed of runs as one streaming operator: new lines in order, changes of state, one end per run.

``feed`` keeps, for each run, how far it was read, its state, and the lines that came before one that is still missing.  Timers
in event time end a run that stood still for too long or lasts too long, and forget an ended run later.  It needs the RocksDB state
store (``use_rocksdb``), as timers and lists do.

``recent`` keeps the last lines of each run, each (time, message) once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FINAL = ("completed", "failed", "cancelled")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class RunFeed(StatefulProcessor):
    """``(event, cursor, us, state, message)`` from a run's lines ``(cursor, us, state, message)``; times in microseconds.

    Lines are numbered from 1.  A line is reported once all before it have come, or once the watermark has passed it, whichever is
    first: until then it is held.  A number that was reported already is a replay and adds nothing.
    """

    def __init__(self, final: tuple[str, ...], idle: float, most: float, keep: float):
        self.final, self.idle, self.most, self.keep = final, int(idle * 1000), int(most * 1000), int(keep * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # The last cursor that was reported, the state, when the run began and was last heard of, whether it has ended.
        self.run = handle.getValueState("run", "cursor long, state string, begun long, last long, ended boolean")
        self.held = handle.getListState("held", "cursor long, us long, state string, message string")

    def _timers(self, wanted: set[int]) -> None:
        now = set(self.handle.listTimers())
        for t in now - wanted:
            self.handle.deleteTimer(t)
        for t in wanted - now:
            self.handle.registerTimer(t)

    def _lines(self, lines: list[tuple], upto: int, now: tuple) -> tuple[list[tuple], list[tuple], tuple]:
        """Reported events, lines that stay held, and the run's new state; lines not after ``upto`` don't wait for earlier ones."""
        cursor, state, begun, last, ended = now
        out, rest = [], []
        for line in sorted(lines, key=lambda x: x[0]):
            number, us, new, message = line
            if ended or number <= cursor:
                continue
            if number > cursor + 1 and (rest or us // 1000 > upto):
                rest.append(line)
                continue
            cursor, last = number, max(last, us // 1000)
            out.append(("log", number, us, new, message))
            if new is not None and new != state:
                state = new
                out.append(("progress", number, us, state, None))
            if state in self.final:
                ended = True
                out.append(("done", number, us, state, None))
        return out, [] if ended else rest, (cursor, state, begun, last, ended)

    def _step(self, key: tuple, lines: list[tuple], now: tuple, upto: int) -> Iterator[pd.DataFrame]:
        out, rest, now = self._lines(lines, upto, now)
        # What is held counts as a sign of life.
        now = (*now[:3], max([now[3], *(x[1] // 1000 for x in rest)]), now[4])
        self.run.update(now)
        if rest:
            self.held.put(rest)
        else:
            self.held.clear()
        timers = {now[3] + self.keep} if now[4] else {now[3] + self.idle, now[2] + self.most, *(x[1] // 1000 for x in rest)}
        self._timers({max(t, upto + 1) for t in timers})
        yield self._frame(key, out)

    def _frame(self, key: tuple, out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["event", "cursor", "us", "state", "message"])
        frame.insert(0, "run", key[0])
        return frame

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        lines = [(int(c), int(t), s, m) for pdf in rows for c, t, s, m in zip(pdf["cursor"], pdf["us"], pdf["state"], pdf["message"], strict=True)]
        first = min(x[1] // 1000 for x in lines)
        now = tuple(self.run.get()) if self.run.exists() else (0, None, first, first, False)
        now = (*now[:2], min(now[2], first), *now[3:])
        yield from self._step(key, [*self._kept(), *lines], now, timerValues.getCurrentWatermarkInMs())

    def _kept(self) -> list[tuple]:
        return [tuple(x) for x in self.held.get()] if self.held.exists() else []

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        if not self.run.exists():
            return
        now, upto = tuple(self.run.get()), timerValues.getCurrentWatermarkInMs()
        if now[4]:
            if upto >= now[3] + self.keep:
                self.run.clear()
                self._timers(set())
            return
        # What was held up to here comes first, as it may end the run by itself.
        frames = list(self._step(key, self._kept(), now, upto))
        now = tuple(self.run.get())
        idle, whole = now[3] + self.idle, now[2] + self.most
        if not now[4] and upto >= min(idle, whole):
            reason = "stalled" if idle <= whole else "too long"
            frames.append(self._frame(key, [("done", now[0], min(idle, whole) * 1000, "failed", reason)]))
            self.run.update((now[0], "failed", now[2], now[3], True))
            self.held.clear()
            self._timers({max(now[3] + self.keep, upto + 1)})
        yield from frames

    def close(self) -> None:
        pass


def feed(stream: DataFrame, run: str, cursor: str, at: str, state: str, message: str, final: tuple[str, ...] = FINAL, idle: float = 300.0, most: float = 6 * 3600.0, keep: float = 24 * 3600.0, delay: str = "10 minutes") -> DataFrame:
    """``run, event, cursor, at, state, message``: the feed of all runs, as a stream to append.

    ``log`` for each line, in the order of ``cursor`` (from 1) and once each; ``progress`` where the state differs from the one before;
    ``done`` once per run: with its final state, or 'failed' if nothing came for ``idle`` seconds ('stalled') or the run has lasted
    ``most`` seconds ('too long'), whichever comes first.  Nothing follows ``done``; the run is forgotten ``keep`` seconds
    after its last line.  A line without a state keeps the last one; lines without run, cursor or time are left out.  Rows behind the
    watermark (``delay``) are dropped by Spark.
    """
    rows = stream.select(F.col(run).cast("string").alias("run"), F.col(cursor).cast("long").alias("cursor"), F.col(at).cast("timestamp").alias("at"), F.col(state).alias("state"), F.col(message).alias("message"))
    rows = rows.where("run is not null and cursor is not null and at is not null").withColumn("us", F.unix_micros("at")).withWatermark("at", delay)
    out = rows.groupBy("run").transformWithStateInPandas(RunFeed(final, idle, most, keep), "run string, event string, cursor long, us long, state string, message string", "Append", "EventTime")
    return out.select(F.col("run").alias(run), "event", "cursor", F.timestamp_micros("us").alias("at"), "state", "message")


class RecentLines(StatefulProcessor):
    """The last ``most`` distinct lines of a run, kept as an ordered list; each batch reports the runs that it changes."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lines = handle.getListState("lines", "position long, us long, message string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        before = [tuple(x) for x in self.lines.get()] if self.lines.exists() else []
        # Once lines were evicted, one that lies before all that are held is old, or equal to one that was evicted.
        least = before[0][0] if len(before) == self.most else None
        held = {(t, m): p for p, t, m in before}
        for pdf in rows:
            for p, t, m in zip(pdf["position"], pdf["us"], pdf["message"], strict=True):
                t = int(t)
                old = held.get((t, m))
                if (least is None or p > least) and (old is None or p < old):
                    held[t, m] = int(p)
        now = sorted((p, t, m) for (t, m), p in held.items())[-self.most :]
        if now != before:
            self.lines.put(now)
            yield pd.DataFrame([(key[0], k + 1, *x) for k, x in enumerate(now)], columns=["run", "place", "position", "us", "message"])

    def close(self) -> None:
        pass


def recent(stream: DataFrame, run: str, at: str, message: str, order: str, most: int = 200) -> DataFrame:
    """``run, place, order, at, message``: the last ``most`` lines of each run, of equal ones (time and message) the first.

    In update mode each batch gives the whole list of each run that it changes, so a sink replaces by run; the state
    of a run is ``most`` lines.  Lines of a run come in the order of ``order`` between batches, up to ``most`` lines late; replays add nothing.
    """
    rows = stream.select(F.col(run).cast("string").alias("run"), F.col(order).cast("long").alias("position"), F.unix_micros(F.col(at).cast("timestamp")).alias("us"), F.col(message).alias("message"))
    rows = rows.where("run is not null and position is not null and us is not null and message is not null")
    out = rows.groupBy("run").transformWithStateInPandas(RecentLines(most), "run string, place int, position long, us long, message string", "Update", "None")
    return out.select(F.col("run").alias(run), "place", F.col("position").alias(order), F.timestamp_micros("us").alias(at), F.col("message").alias(message))

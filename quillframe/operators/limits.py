"""Decisions that depend on the decisions before: sliding limits and adaptive pacing, without one task per key.

A limit forgets all after a pause of the window's length, so a key's events fall into spells that are decided on their own.  Where
pauses are is seen in counts of (key, stretch of time), not by sorting a key's events.  Within a spell only accepted
events are stepped through: the next one after a full window is found by binary search in a batch of sorted times.

Pacing never forgets, but what a block of events does to its state has a short form whatever the state was, and these
forms combine.  So events are dealt to ranges of like size in the order of (key, time), each range sums up the blocks at its two ends, a
few numbers per range give the state in which each range begins, and then all ranges are folded at once.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.operators.helpers import unused
from quillframe.operators.tables import TASK_BIT
from quillframe.sources.store import written


def _groups(batch: pa.RecordBatch, *keys: str) -> Iterator[tuple[int, int, tuple]]:
    """Bounds and values of the runs of equal keys in a batch."""
    columns = [batch.column(k).to_pylist() for k in keys]
    start = 0
    for k in range(1, batch.num_rows + 1):
        if k == batch.num_rows or any(c[k] != c[start] for c in columns):
            yield start, k, tuple(c[start] for c in columns)
            start = k


def _limited(times: np.ndarray, held: deque, limit: int, window: float) -> tuple[np.ndarray, np.ndarray]:
    """Which of the sorted times are accepted, and seconds to wait for the others; ``held`` has the accepted times of the window."""
    n = len(times)
    accepted, wait = np.zeros(n, bool), np.zeros(n, np.int32)
    k = 0
    while k < n:
        while held and times[k] - held[0] >= window:
            held.popleft()
        if len(held) < limit:
            accepted[k] = True
            held.append(times[k])
            k += 1
            continue
        # All are rejected up to the first one that is a window after the oldest.
        end = int(np.searchsorted(times[k:], held[0] + window)) + k
        while end < n and times[end] - held[0] < window:
            end += 1
        while end > k and times[end - 1] - held[0] >= window:
            end -= 1
        wait[k:end] = np.maximum(1, (window - (times[k:end] - held[0])).astype(np.int64))
        k = end
    return accepted, wait


def limited(events: DataFrame, key: str, at: str, limit: int = 10, window: float = 60.0) -> DataFrame:
    """Events with ``accepted`` and ``retry_after``: at most ``limit`` accepted ones per key in ``window`` seconds.

    ``at`` is in seconds.  A rejected event does not count.  An event without a time is rejected, with no time to retry; null
    is a key like any other.  A key that pauses for three windows now and then is spread over as many tasks as it has spells; one that never
    does keeps one task, whose steps follow its accepted events only.
    """
    stretch, spell, other, same = (unused(c, events) for c in ("_stretch", "_spell", "_other", "_same"))
    rows = events.withColumn(stretch, F.floor(F.col(at) / window))
    seen = rows.where(F.col(stretch).isNotNull()).select(F.col(key).alias(other), F.col(stretch).alias(same)).distinct()
    by_key = W.partitionBy(other).orderBy(same)
    # Two empty stretches between events are a pause of a window at least, however the division was rounded.
    begins = F.when(F.coalesce(F.col(same) - F.lag(same).over(by_key) > 2, F.lit(True)), F.col(same))
    seen = seen.withColumn(spell, begins).withColumn(spell, F.last(spell, ignorenulls=True).over(by_key.rowsBetween(W.unboundedPreceding, 0)))
    timed = rows.join(seen, F.col(key).eqNullSafe(F.col(other)) & (F.col(stretch) == F.col(same))).drop(other, same)
    timed = timed.repartition(key, spell).sortWithinPartitions(key, spell, at).drop(stretch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, deque()
        for batch in batches:
            times, parts = batch.column(at).cast(pa.float64()).to_numpy(), []
            for a, z, own in _groups(batch, key, spell):
                if own != current:
                    current, held = own, deque()
                parts.append(_limited(times[a:z], held, limit, window))
            accepted, wait = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t) for k, t in ((0, bool), (1, np.int32)))
            kept = [c for c in batch.schema.names if c != spell]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(accepted), pa.array(wait)], [*kept, "accepted", "retry_after"])

    schema = T.StructType([*events.schema.fields, T.StructField("accepted", T.BooleanType()), T.StructField("retry_after", T.IntegerType())])
    untimed = events.where(F.col(at).isNull()).withColumns({"accepted": F.lit(False), "retry_after": F.lit(None).cast("int")})
    return timed.mapInArrow(run, schema).unionByName(untimed)


@dataclass
class Pace:
    """The state of a key: rejections since the last recovery, the interval, successes in a row."""

    rejections: int
    interval: float
    successes: int


@dataclass
class Block:
    """What a block of events does to any state.

    ``lead`` successes come first.  If a rejection follows, the interval after these is then shifted by ``shift`` and held between ``low`` and
    ``high``, ``successes`` are those since the last one, and ``rejections`` those since the last recovery, or since the lead if none came.
    """

    lead: int = 0
    rejected: bool = False
    shift: float = 0.0
    low: float = float("-inf")
    high: float = float("inf")
    successes: int = 0
    rejections: int = 0
    recovered: bool = False


class Pacing:
    def __init__(self, base: float, most: float, recover: int):
        self.base, self.most, self.recover = base, most, recover

    def new(self) -> Pace:
        return Pace(0, self.base, 0)

    def step(self, state: Pace, refused: bool | None, hint: float | None) -> tuple[float, float]:
        """The interval and the cooldown after an event."""
        if refused:
            state.rejections += 1
            state.successes = 0
            state.interval = min(self.most, state.interval + 0.5)
            return state.interval, float(min(900, 60 * 2 ** min(state.rejections - 1, 10)) if hint is None else hint)
        state.successes += 1
        if state.successes >= self.recover:
            state.rejections, state.successes, state.interval = 0, 0, max(self.base, state.interval - 0.5)
        return state.interval, 0.0

    def sum_up(self, block: Block, refused: bool | None) -> None:
        """Takes one more event into a block."""

        def move(by: float, low: float, high: float) -> None:
            block.shift += by
            block.low, block.high = (min(max(x + by, low), high) for x in (block.low, block.high))

        if refused:
            block.rejected = True
            block.rejections, block.successes = block.rejections + 1, 0
            move(0.5, float("-inf"), self.most)
        elif not block.rejected:
            block.lead += 1
        else:
            block.successes += 1
            if block.successes >= self.recover:
                block.successes, block.rejections, block.recovered = 0, 0, True
                move(-0.5, self.base, float("inf"))

    def after(self, state: Pace, block: Block) -> Pace:
        """The state after a block."""
        recoveries, successes = divmod(state.successes + block.lead, self.recover)
        interval = max(self.base, state.interval - 0.5 * recoveries)
        rejections = 0 if recoveries else state.rejections
        if not block.rejected:
            return Pace(rejections, interval, successes)
        interval = min(max(interval + block.shift, block.low), block.high)
        return Pace(block.rejections + (0 if block.recovered else rejections), interval, block.successes)


def paced(events: DataFrame, key: str, order: str, rejected: str, hint: str, base: float = 1.0, most: float = 5.0, recover: int = 250) -> DataFrame:
    """Events with the ``interval`` and ``cooldown`` that hold after them.

    A rejection adds 0.5 s to the interval, and the cooldown is the server's hint, or 60 s doubled with each one,
    900 s at most.  ``recover`` successes in a row take 0.5 s off again.  Null is a key like any other; a null rejection is a success.
    Events of a key that share an ``order`` come in any order.
    """
    pacing = Pacing(base, most, recover)
    own = unused("_own", events)
    rows = written(events.repartitionByRange(key, order).sortWithinPartitions(key, order).withColumn(own, F.monotonically_increasing_id()))
    part = F.shiftright(own, TASK_BIT)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The blocks of the first and of the last key of each range: ``(range, last, key, block)``."""
        found: dict[int, list] = {}
        for batch in batches:
            numbers = [x >> TASK_BIT for x in batch.column(own).to_pylist()]
            for number, k, refused in zip(numbers, batch.column(key).to_pylist(), batch.column(rejected).to_pylist(), strict=True):
                blocks = found.setdefault(number, [])
                if not blocks or blocks[-1][0] != k:
                    # Of the blocks between the first and the last none is needed.
                    del blocks[1:]
                    blocks.append((k, Block()))
                pacing.sum_up(blocks[-1][1], refused)
        out = [(number, at, k, *astuple(b)) for number, blocks in found.items() for at, (k, b) in enumerate(blocks)]
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.bool_(), *[pa.float64()] * 3, pa.int64(), pa.int64(), pa.bool_()]
        columns = zip(*out, strict=True) if out else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], block_names)

    block_names = ["range", "place", "key", "lead", "rejected", "shift", "low", "high", "successes", "rejections", "recovered"]
    block_kinds = [T.LongType(), T.IntegerType(), T.StringType(), T.LongType(), T.BooleanType(), *[T.DoubleType()] * 3, T.LongType(), T.LongType(), T.BooleanType()]
    dealt = rows.repartition(part).sortWithinPartitions(own)
    summary = dealt.select(own, F.col(key).cast("string").alias(key), rejected).mapInArrow(ends, T.StructType([T.StructField(n, t) for n, t in zip(block_names, block_kinds, strict=True)]))
    # At most two rows for each range, whatever the number of events or keys.
    entering: dict[int, Pace] = {}
    carried_key, carried = None, None
    for r in summary.orderBy("range", "place").collect():
        block = Block(*r[3:])
        begins = carried if carried is not None and r["key"] == carried_key and r["place"] == 0 else pacing.new()
        if r["place"] == 0:
            entering[r["range"]] = begins
        carried_key, carried = r["key"], pacing.after(begins, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, current, state = None, None, None
        for batch in batches:
            out = []
            for x, k, refused, given in zip(*(batch.column(c).to_pylist() for c in (own, key, rejected, hint)), strict=True):
                if x >> TASK_BIT != number:
                    number, current = x >> TASK_BIT, k
                    state = Pace(*astuple(entering[number]))
                elif k != current:
                    current, state = k, pacing.new()
                out.append(pacing.step(state, refused, given))
            kept = [c for c in batch.schema.names if c != own]
            added = list(zip(*out, strict=True)) if out else [(), ()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(a, pa.float64()) for a in added)], [*kept, "interval", "cooldown"])

    schema = T.StructType([*events.schema.fields, T.StructField("interval", T.DoubleType()), T.StructField("cooldown", T.DoubleType())])
    return dealt.mapInArrow(run, schema)

"""Passages that repeat anywhere in a corpus, found with suffix arrays of the places that can repeat.

1. Anchors.  In every window of ``length`` bytes the core (a run of ``core`` bytes) of least hash is an
   anchor.  Two equal strings of ``length`` bytes hold equal anchors at equal offsets, so a string
   repeats only around an anchor whose hash occurs again.  The hashes are counted, and only the
   anchors that occur again go on.
2. Contexts.  The bytes around an anchor that a string holding it can reach are its context.  Where
   a whole context occurs again, all of it repeats, and the equal contexts are one from here on.
3. Suffix arrays.  The different contexts of one anchor hash are laid one after another, as blocks of
   bytes counted from the anchor, with the core as one symbol, and sorted by ``lyndon``.
   Neighbours in suffix order with long common prefixes are strings that repeat; the ends of a
   repeat within a block are compared byte by byte.
4. A hash with very many contexts is divided by content: each context stands under several longer
   cores, and is compared only with those that share one of these whole.  Their contexts are
   mostly equal by now.  If a longer core still has very many, they are dealt to parts, each with
   its own suffix array; a part hands on one row per string, and equal strings of several parts
   meet in a grouped count.
5. The repeats of each document are joined back to it and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.llm.common import cut, discard, runs, text_pieces, texts, unused
from quillframe.llm.lyndon import suffix_arrays
from quillframe.llm.wordhash import eights, mix

#: Long texts are searched in slices of so many bytes, with what lies around them.
SLICE = 1 << 19
#: An anchor hash with more contexts than this is split.
PART = 512
#: Contexts whose suffix arrays are built in step.
STEP_CONTEXTS = 8_000

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: A number for each column of a context.
_KEYS = np.random.default_rng(20240229).integers(1, 1 << 63, 1024, dtype=np.uint64)
_powers = {True: np.ones(1, _U), False: np.ones(1, _U)}


def _power(up: bool, n: int) -> np.ndarray:
    """Powers 0..n-1 of the base or its inverse, kept for the next piece; pieces are of bounded size."""
    if len(_powers[up]) < n:
        grown = np.full((n + 65535) // 65536 * 65536, _BASE if up else _INVERSE)
        grown[0] = 1
        _powers[up] = np.cumprod(grown, dtype=_U)
    return _powers[up][:n]


@dataclass(frozen=True)
class Shape:
    """Lengths in bytes; ``length - core`` is a multiple of ``block``."""

    length: int = 200
    core: int = 100
    block: int = 10

    @property
    def gram(self) -> int:
        """Bytes that are hashed together."""
        return min(8, self.core)

    @property
    def side(self) -> int:
        return self.length - self.core

    @property
    def inner(self) -> Shape:
        """The shape with longer cores, byte by byte beside them."""
        return Shape(self.length, self.length - min(self.block + 2, self.side), 1)


def _slide(values: np.ndarray, width: int, least) -> np.ndarray:
    """The least (or greatest) of each ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        values = least(values[:-have], values[have:])
        have *= 2
    return least(values[: -(width - have)], values[width - have :]) if have < width else values


class Spans:
    """Hashes of any spans of some bytes: sums of hashed neighbours, times powers of a base.

    The neighbours' hashes keep two strings that are built alike, of two letters each, from
    cancelling out.  A span has at least ``gram`` bytes.
    """

    def __init__(self, data: np.ndarray, gram: int):
        n, self.gram = len(data), gram
        self.sums = np.zeros(n + 1, _U)
        values = mix(eights(data)[:n] & _U((1 << 8 * gram) - 1))
        values *= _power(True, n)
        np.cumsum(values, out=self.sums[1:])
        self.down = _power(False, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end - (self.gram - 1)] - self.sums[start]) * self.down[start])

    def sliding(self, width: int) -> np.ndarray:
        """Of all spans of ``width`` bytes."""
        step = width - self.gram + 1
        raw = self.sums[step : len(self.sums) - self.gram + 1] - self.sums[: len(self.sums) - width]
        raw *= self.down[: len(raw)]
        return mix(raw)


def anchors(rows: list[bytes], shape: Shape) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchors of the texts: which text, place, bytes of context before and after it, hash, context's hash."""
    pending: list[tuple[int, int, int, int, int]] = []
    held = 0
    for k, text in enumerate(rows):
        if len(text) < shape.length:
            continue
        for own in range(0, len(text), SLICE):
            begin, own_end = max(own - shape.length, 0), min(own + SLICE, len(text))
            end = min(own_end + shape.length + shape.side, len(text))
            pending.append((k, begin, end, own, own_end))
            held += end - begin
            if held >= SLICE:
                yield _anchors_of(rows, pending, shape)
                pending, held = [], 0
    if pending:
        yield _anchors_of(rows, pending, shape)


def _anchors_of(rows: list[bytes], slices: list[tuple[int, int, int, int, int]], shape: Shape) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join(rows[k][begin:end] for k, begin, end, _, _ in slices), np.uint8)
    text, begin, end, own, own_end = np.array(slices, np.int64).T
    stop = np.cumsum(end - begin)
    start = stop - (end - begin)
    if len(data) < shape.length:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, _U),) * 2
    spans, width = Spans(data, shape.gram), shape.side + 1
    hashes = spans.sliding(shape.core)
    least = _slide(hashes, width, np.minimum)
    # Windows that lie within one slice.
    inside = np.zeros(len(data) + 1, np.int32)
    whole = stop - start >= shape.length
    inside[start[whole]] += 1
    inside[stop[whole] - shape.length + 1] -= 1
    least[np.cumsum(inside)[: len(least)] == 0] = 0
    pad = np.zeros(shape.side, _U)
    at = np.flatnonzero(_slide(np.concatenate([pad, least, pad]), width, np.maximum) == hashes)
    which = np.searchsorted(stop, at, "right")
    place = at - start[which] + begin[which]
    mine = (place >= own[which]) & (place < own_end[which])
    at, which, place = at[mine], which[mine], place[mine]
    low, high = np.maximum(at - shape.side, start[which]), np.minimum(at + shape.length, stop[which])
    context = spans.of(low, high) ^ ((at - low).astype(_U) << _U(32))
    return text[which], place, at - low, high - at, hashes[at], context


def _counted(shape: Shape):
    """``(hash, n)``, added up over a piece of the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in text_pieces(b)):
            for found in anchors(texts(batch), shape):
                values, n = np.unique(found[4].view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n)], ["hash", "n"])

    return run


def _placed(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in text_pieces(b)):
            ids, fps = batch.column("id").to_numpy(), batch.column("fp").to_numpy()
            for text, place, before, after, hashes, context in anchors(texts(batch), shape):
                columns = [ids[text], fps[text], place, before.astype(np.int32), after.astype(np.int32), hashes.view(np.int64), context.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "fp", "place", "before", "after", "hash", "context"])

    return run


_CONTEXT = "level int, hash long, context long, single boolean, id long, fp long, place long, before int, after int, bytes binary"
_CONTEXT_NAMES = [x.split()[0] for x in _CONTEXT.split(", ")]


def _fetched(shape: Shape):
    """The contexts that are wanted from each text: with their bytes, or under longer cores if their hash is divided."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in text_pieces(b)):
            rows, wanted = texts(batch), batch.column("wanted")
            per_row = np.diff(wanted.offsets.to_numpy())
            row = np.repeat(np.arange(len(rows)), per_row)
            fields = {f.name: wanted.flatten().field(f.name).to_numpy(zero_copy_only=False) for f in wanted.type.value_type}
            ids, fps = batch.column("id").to_numpy()[row], batch.column("fp").to_numpy()[row]
            order = np.argsort(fields["divided"], kind="stable")
            for a in range(0, len(row), 2_000):
                at = order[a : a + 2_000]
                place, before, after = (fields[c][at] for c in ("place", "before", "after"))
                blobs = [rows[r][p - b : p + e] for r, p, b, e in zip(row[at], place, before, after, strict=True)]
                columns = (fields["hash"][at], fields["single"][at], ids[at], fps[at], place, before, after)
                divided = fields["divided"][at]
                whole = np.flatnonzero(~divided)
                if len(whole):
                    yield _contexts(0, *(c[whole] for c in columns), np.zeros(len(whole), np.int64), [blobs[k] for k in whole])
                if divided.any():
                    many = np.flatnonzero(divided)
                    yield _divided(*(c[many] for c in columns), [blobs[k] for k in many], shape)

    return run


def _contexts(level, hashes, single, ids, fps, place, before, after, context, blobs) -> pa.RecordBatch:
    columns = [np.full(len(ids), level, np.int32), hashes, context, single, ids, fps, place, before.astype(np.int32), after.astype(np.int32)]
    return pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.array(blobs, pa.binary())], _CONTEXT_NAMES)


def _divided(hashes, single, ids, fps, place, before, after, blobs, shape: Shape) -> pa.RecordBatch:
    """Each context under its longer cores; a row's bytes are those beside the core."""
    inner = shape.inner
    data = np.frombuffer(b"".join(blobs), np.uint8)
    length = np.array([len(b) for b in blobs])
    begin = np.cumsum(length) - length
    spans, raw = Spans(data, shape.gram), data.tobytes()
    out = []
    for k, first in enumerate(range(0, shape.side + 1, inner.side + 1)):
        # Where the core starts in each context, and whether the context holds all of it.
        start = first + inner.side - (shape.side - before)
        inside = np.flatnonzero((start >= 0) & (start + inner.core <= length))
        start = start[inside]
        low, high = np.maximum(start - inner.side, 0), np.minimum(start + inner.length, length[inside])
        at = begin[inside]
        core = spans.of(at + start, at + start + inner.core)
        core = mix(core ^ mix(hashes[inside].view(_U) + _U(k)))
        context = spans.of(at + low, at + high) ^ ((start - low).astype(_U) << _U(32))
        ends = [raw[o + a : o + s] + raw[o + s + inner.core : o + z] for o, a, s, z in zip(at, low, start, high, strict=True)]
        out.append(_contexts(1, core.view(np.int64), single[inside], ids[inside], fps[inside], place[inside] - before[inside] + start, start - low, high - start, context.view(np.int64), ends))
    return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if sum(x.num_rows for x in out) else out[0]


def _classes(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of equal key rows, and for each row whether it has an equal one."""
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    ids = np.empty(len(order), np.int64)
    ids[order] = np.cumsum(new) - 1
    return ids, np.bincount(ids)[ids] > 1


def repeated_offsets(padded: np.ndarray, valid: tuple[np.ndarray, np.ndarray], groups: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """For each context the first and the last offset at which a string of ``shape.length`` bytes repeats in its group.

    ``padded`` has one row per context, the core at column ``shape.side``; bytes are raised by one,
    and 0 stands for none.  Rows of a group are neighbours, ``groups`` holds their boundaries.  A string may
    start at the offsets from ``valid[0]`` to ``valid[1]``.  Nothing found: first > last.
    """
    rows, side, block = len(padded), shape.side, shape.block
    blocks = side // block
    first, last = np.full(rows, side + 1), np.full(rows, -1)
    if rows == 0:
        return first, last
    # Symbols: the left blocks, the core, the right blocks.
    values = padded.astype(_U) + _U(1)

    def piece(begin: int, end: int) -> np.ndarray:
        # Wrapping sums of values that are mixed by place: equal pieces have equal sums.
        return mix(mix(values[:, begin:end] ^ _KEYS[: end - begin]).sum(axis=1, dtype=_U))

    at = [(k * block, (k + 1) * block) for k in range(blocks)]
    at += [(side, shape.length)] + [(shape.length + k * block, shape.length + (k + 1) * block) for k in range(blocks)]
    hashed = np.stack([piece(*x) for x in at], axis=1)
    symbols = np.unique(hashed.reshape(-1), return_inverse=True)[1].reshape(hashed.shape)
    wide = symbols.shape[1]
    order = suffix_arrays(symbols.reshape(-1), groups * wide)
    # Strings start in the left blocks or at the core: only these suffixes matter.
    order = order[order % wide <= blocks]
    row, column = order // wide, order % wide
    group = np.searchsorted(groups, row, "right")
    alike = np.zeros(len(order), np.int64)
    going = np.arange(1, len(order))
    going = going[group[1:] == group[:-1]]
    for k in range(blocks + 1):
        going = going[symbols[row[going], column[going] + k] == symbols[row[going - 1], column[going - 1] + k]]
        alike[going] += 1
    # Aligned strings: blocks + 1 symbols alike, at the same offset of different contexts.
    _, again = _classes([column, np.cumsum(alike < blocks + 1)])
    offset = column * block
    good = again & (offset >= valid[0][row]) & (offset <= valid[1][row])
    np.minimum.at(first, row[good], offset[good])
    np.maximum.at(last, row[good], offset[good])
    # Strings that start within a block: all but its end, the blocks between, and a start of the block after.
    inner, held = _classes([column, np.cumsum(alike < blocks)])
    # Only where a row of the class still lacks such an end.
    open_ = (column > 0) & ((column * block <= first[row]) | ((column - 1) * block >= last[row]))
    held &= (column > 0) & (np.bincount(inner, weights=open_) > 0)[inner]
    row, column, inner = row[held], column[held], inner[held]
    for short in range(1, block):
        offset = column * block - short
        head, tail = np.zeros(len(row), _U), np.zeros(len(row), _U)
        for k in range(short):
            head = head * _BASE + values[row, offset + k]
        for k in range(block - short):
            tail = tail * _BASE + values[row, offset + short + shape.length - block + k]
        _, again = _classes([tail, head, inner])
        good = again & (offset >= valid[0][row]) & (offset <= valid[1][row])
        np.minimum.at(first, row[good], offset[good])
        np.maximum.at(last, row[good], offset[good])
    return first, last


def _padded(table: pa.Table, shape: Shape, bare: bool) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Contexts as rows of numbers; ``bare`` ones come without their core, which is the same within a group."""
    blobs = table.column("bytes").to_pylist()
    if bare:
        core = bytes(shape.core)
        blobs = [b[:k] + core + b[k:] for b, k in zip(blobs, table.column("before").to_pylist(), strict=True)]
    length = np.array([len(b) for b in blobs])
    lead = shape.side - table.column("before").to_numpy()
    out = np.zeros((len(blobs), shape.length + shape.side), np.uint16)
    cell = np.arange(out.shape[1])
    out[(cell >= lead[:, None]) & (cell < (lead + length)[:, None])] = np.frombuffer(b"".join(blobs), np.uint8).astype(np.uint16) + 1
    return out, (lead, lead + length - shape.length)


def _strings(padded: np.ndarray, valid: tuple[np.ndarray, np.ndarray], hashes: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, offset and hash of every string of every context; the anchor's hash and the offset are part of the hash."""
    wide = padded.shape[1]
    up = np.cumprod(np.full(wide, _BASE, _U), dtype=_U)
    down = np.cumprod(np.full(wide, _INVERSE, _U), dtype=_U)
    sums = np.zeros((len(padded), wide + 1), _U)
    np.cumsum(mix(padded.astype(_U)) * up, axis=1, out=sums[:, 1:])
    offset = np.arange(shape.side + 1)
    value = mix(((sums[:, shape.length :] - sums[:, : shape.side + 1]) * down[: shape.side + 1]) ^ mix(hashes[:, None] + offset.astype(_U)))
    row, offset = np.nonzero((offset >= valid[0][:, None]) & (offset <= valid[1][:, None]))
    return row, offset, value[row, offset]


def _sorted_out(shape: Shape, bare: bool):
    """Repeats within parts, as rows ``(id, fp, start, end)``; and for split hashes, one row with ``string`` for each."""

    def flush(tables: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(tables)
        key = [table.column(c).to_numpy() for c in ("hash", "part")]
        new = np.ones(table.num_rows, bool)
        new[1:] = (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])
        groups = np.append(np.flatnonzero(new), table.num_rows)
        padded, valid = _padded(table, shape, bare)
        first, last = repeated_offsets(padded, valid, groups, shape)
        ids, fps, place = (table.column(c).to_numpy() for c in ("id", "fp", "place"))
        # A context that occurs again repeats as a whole anyway.
        found = np.flatnonzero((first <= last) & table.column("single").to_numpy())
        origin = place - shape.side
        start, end = origin[found] + first[found], origin[found] + last[found] + shape.length
        string = np.full(len(found), 0, np.int64)
        row = found
        split = np.flatnonzero(table.column("parts").to_numpy() > 1)
        if len(split):
            hashes = key[0].view(_U)
            r, offset, value = _strings(padded[split], (valid[0][split], valid[1][split]), hashes[split], shape)
            # One row for each string of a part.
            part = np.searchsorted(groups, split[r], "right").astype(_U)
            _, one = np.unique(mix(value + part), return_index=True)
            r, offset, value = split[r[one]], offset[one], value[one] | _U(1)
            row = np.concatenate([row, r])
            start, end = np.concatenate([start, origin[r] + offset]), np.concatenate([end, origin[r] + offset + shape.length])
            string = np.concatenate([string, value.view(np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[row], fps[row], start, end, string)], ["id", "fp", "start", "end", "string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for table, _ in runs(batches, ["hash", "part"]):
            held.append(table)
            n += table.num_rows
            if n >= STEP_CONTEXTS:
                yield flush(held)
                held, n = [], 0
        if held:
            yield flush(held)

    return run


def _keyed(docs: DataFrame, prefix: str) -> dict[str, Column]:
    """What tells rows apart, besides rows that are equal in id and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return {f"{prefix}id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), f"{prefix}fp": F.xxhash64(text, F.col("doc_id").isNull())}


def repeats(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """``(id, fp, spans)``: the places of each text that repeat, as sorted ``start << 32 | end``, overlapping or not."""
    docs = docs.where(F.octet_length(F.col("text").cast("string")) >= shape.length).select(*(c.alias(n) for n, c in _keyed(docs, "").items()), F.col("text").cast("string").alias("text"))
    counted = docs.select("text").mapInArrow(_counted(shape), "hash long, n long")
    again = cut(counted.groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1").select("hash"))
    placed = docs.mapInArrow(_placed(shape), "id long, fp long, place long, before int, after int, hash long, context long")
    hits = cut(placed.join(again, "hash"))
    contexts = hits.groupBy("hash", "context").agg(F.count("*").alias("n"), F.min(F.struct("id", "fp", "place", "before", "after")).alias("at"))
    contexts = cut(contexts)
    span = [F.col("id"), F.col("fp"), (F.col("place") - F.col("before")).alias("start"), (F.col("place") + F.col("after")).alias("end")]
    spans = hits.join(contexts.where("n > 1").select("hash", "context"), ["hash", "context"]).select(*span)
    several = cut(contexts.groupBy("hash").agg(F.count("*").alias("k")).where("k > 1").select("hash", (F.col("k") > PART).alias("divided")))
    one = F.struct("hash", "divided", (F.col("n") == 1).alias("single"), "at.place", "at.before", "at.after")
    wanted = contexts.join(several, "hash").select("at.id", "at.fp", one.alias("one")).groupBy("id", "fp").agg(F.collect_list("one").alias("wanted"))
    fetched = docs.join(wanted, ["id", "fp"]).select("id", "fp", "text", "wanted")
    fetched = cut(fetched.mapInArrow(_fetched(shape), _CONTEXT), "zstd")
    spans = spans.unionByName(_by_parts(fetched.where("level = 0").withColumn("part", F.lit(0)).withColumn("parts", F.lit(1)), shape, False))
    # Under longer cores: contexts that occur again repeat as a whole, the others are sorted.
    longer = fetched.where("level = 1").drop("level")
    held = cut(longer.groupBy("hash", "context").agg(F.sum(F.when(F.col("single"), 1).otherwise(2)).alias("n"), F.min(F.struct("id", "fp", "place", "before", "after", "bytes")).alias("at")))
    spans = spans.unionByName(longer.where("single").join(held.where("n > 1").select("hash", "context"), ["hash", "context"]).select(*span))
    several = held.groupBy("hash").agg(F.count("*").alias("k")).where("k > 1").select("hash", F.ceil(F.col("k") / PART).alias("parts"))
    apart = held.join(cut(several), "hash").select("hash", "parts", (F.col("n") == 1).alias("single"), "at.*")
    spans = spans.unionByName(_by_parts(apart.withColumn("part", F.pmod(F.xxhash64("id", "fp", "place"), "parts")), shape.inner, True))
    packed = F.shiftleft("start", 32).bitwiseOR(F.col("end"))
    return spans.groupBy("id", "fp").agg(F.array_sort(F.collect_set(packed)).alias("spans"))


def _by_parts(contexts: DataFrame, shape: Shape, bare: bool) -> DataFrame:
    """``(id, fp, start, end)`` of what repeats among the contexts of each hash."""
    rows = contexts.select("hash", "part", "parts", "single", "id", "fp", "place", "before", "bytes")
    found = rows.repartition("hash", "part").sortWithinPartitions("hash", "part").mapInArrow(_sorted_out(shape, bare), "id long, fp long, start long, end long, string long")
    found = cut(found)
    strings = found.where("string <> 0")
    met = strings.groupBy("string").agg(F.count("*").alias("n")).where("n > 1").select("string")
    return found.where("string = 0").drop("string").unionByName(strings.join(met, "string").drop("string"))


def merged(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs that sorted, packed spans cover."""
    if len(spans) == 0:
        return spans, spans
    start, end = spans >> 32, np.maximum.accumulate(spans & 0xFFFFFFFF)
    new = np.append(True, start[1:] > end[:-1])
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def _with_spans(docs: DataFrame, shape: Shape) -> DataFrame:
    prefix = unused(docs.columns, "cut_")
    keys = [f"{prefix}id", f"{prefix}fp"]
    found = cut(repeats(docs, shape)).select(F.col("id").alias(keys[0]), F.col("fp").alias(keys[1]), F.col("spans").alias(f"{prefix}spans"))
    return docs.withColumns(_keyed(docs, prefix)).join(found, keys, "left").select(*docs.columns, f"{prefix}spans")


def _cut_rows(batch: pa.RecordBatch) -> Iterator[tuple[bytes, bytes, int]]:
    """Text, what remains of it, and the number of runs removed, for each row; its spans are the last column."""
    for text, spans in zip(texts(batch), batch.columns[-1], strict=True):
        if not spans.is_valid:
            yield text, text, 0
            continue
        start, end = merged(spans.values.to_numpy())
        kept = b"".join(text[a:z] for a, z in zip([0, *end], [*start, len(text)], strict=True))
        yield text, kept, len(start)


def digests(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs``.

    Every byte that lies in a string of ``shape.length`` bytes which also starts elsewhere, in the same
    text or another, is removed.  A null text counts as empty.  Repeated rows are documents of
    their own, so they repeat one another.  A null ``doc_id`` is passed on, other columns are ignored, and
    an empty table gives an empty result.
    """
    rows = _with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in text_pieces(b)):
            out = [(len(text), len(text) - len(kept), n, hashlib.sha256(kept).hexdigest()) for text, kept, n in _cut_rows(batch)]
            size, removed, spans, digest = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (size, removed, spans)), pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """``docs`` with its repeats cut out of ``text``, its other columns as they are, whatever their names.

    A character that a cut leaves incomplete is dropped; a null text stays null, an empty one empty.
    Repeated rows repeat one another, null ids don't matter, and an empty table stays empty.
    """
    rows, names = _with_spans(docs, shape), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in text_pieces(b)):
            valid = batch.column("text").is_valid().to_pylist()
            kept = [k.decode(errors="ignore") if v else None for v, (_, k, _) in zip(valid, _cut_rows(batch), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()) if c == "text" else batch.column(c) for c in names], names)

    return rows.mapInArrow(run, T.StructType([T.StructField("text", T.StringType()) if f.name == "text" else f for f in docs.schema]))

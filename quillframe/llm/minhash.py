"""MinHash near-duplicate detection by an inverted join over signature coordinates.

1. Every document gets its set of word shingles, a signature of ``coordinates`` minimum hashes and
   a 128-bit fingerprint of the whole set.  Documents with equal sets form a class.
2. Every class is posted under each of its (coordinate, value) pairs.  Two sets of similarity ``s``
   agree in a Binomial(coordinates, s) number of coordinates; ``matches_needed`` is the largest
   threshold that misses a pair of the wanted similarity with a chance below ``miss``.
3. Prefix: a pair that agrees in at least ``t`` of ``k`` coordinates also agrees in one of the
   ``k - t + 1`` rarest coordinates of either.  Only these are joined; values held by one class,
   which are the rarest, can't join and are dropped, and with them most classes.
4. Skip: within a posting list collisions are counted, and a class that already hangs together
   with most of the list through counted collisions is not asked for more.  So a list of n classes
   yields fewer than n pairs.
5. Within each family of classes that hang together, sets are compared whole, and only
   pairs that reach the similarity are links.
6. A large family is refined first.  Two sets that reach the similarity share one of each other's rarest shingles,
   as far as each has more than it may lack; so only members that share such shingles stay together.  Texts that have no more in
   common than a frequent part, such as a template, share none and are not compared at all.
7. Large lists and families are dealt to blocks.  A few hubs of the group visit all of its blocks.
   What hangs together by then, in its largest part, needs no further visit, and only the others visit
   all blocks in turn.  No pair of members that could join two parts goes uncompared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import HUBS, components, cut, forest, runs, small, text_pieces, texts, unused
from quillframe.llm.wordhash import mix, shingle_sets

COORDINATES = 32
LIST_BLOCK = 256
FAMILY_BLOCK = 1 << 17


def matches_needed(coordinates: int, similarity: float, miss: float = 2e-6) -> int:
    """The largest t for which P(Binomial(coordinates, similarity) < t) is at most ``miss``."""
    below = 0.0
    for t in range(coordinates + 1):
        below += math.comb(coordinates, t) * similarity**t * (1 - similarity) ** (coordinates - t)
        if below > miss:
            return max(t, 1)
    return coordinates


def _multipliers(coordinates: int) -> np.ndarray:
    return np.random.default_rng(7).integers(1, 1 << 63, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """For each coordinate the least value of its hash over the set; the set must not be empty."""
    factors, least = _multipliers(coordinates)[:, None], None
    for part in np.array_split(shingles, len(shingles) // 65536 + 1):
        now = ((part[None, :] * factors) >> np.uint64(32)).astype(np.uint32).min(axis=1)
        least = now if least is None else np.minimum(least, now)
    return least


def _numbers(sig: Column, coordinates: int) -> Column:
    """The coordinates of a signature kept as bytes."""
    digits = F.hex(sig)
    return F.array(*(F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long") for k in range(coordinates)))


def sketches(docs: DataFrame, width: int = 5, coordinates: int = COORDINATES) -> DataFrame:
    """``(doc_id, n_shingles, fp, sig)`` for each row of ``(doc_id, text)``; empty sets have no signature."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in text_pieces(b)):
            sizes, fps, sigs = [], [], []
            for s in shingle_sets(texts(batch), width):
                sizes.append(len(s))
                if len(s):
                    fps.append(np.array([s.sum(dtype=np.uint64), mix(s).sum(dtype=np.uint64)]).tobytes())
                    sigs.append(signature(s, coordinates).tobytes())
                else:
                    fps.append(None)
                    sigs.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(fps, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "fp", "sig"])

    return docs.mapInArrow(sketch, "doc_id long, n_shingles long, fp binary, sig binary")


class Signatures:
    """Classes of a posting list, linked if they collide in enough coordinates."""

    def __init__(self, items: list[bytes], needed: int):
        self.sigs, self.needed = np.frombuffer(b"".join(items), np.uint32).reshape(len(items), -1), needed

    def linked(self, k: int) -> np.ndarray:
        hits = (self.sigs == self.sigs[k]).sum(axis=1) >= self.needed
        hits[k] = False
        return np.flatnonzero(hits)


class Sets:
    """Classes of a family, linked if 100 * intersection >= percent * union of their sets.

    One pass over the sets of like size for each that is asked.
    """

    def __init__(self, items: list[bytes], percent: int):
        sets = [np.frombuffer(x, np.uint64) for x in items]
        self.percent = percent
        self.order = np.argsort([len(s) for s in sets], kind="stable")
        self.place = np.argsort(self.order)
        self.sizes = np.array([len(sets[k]) for k in self.order])
        values, self.flat = np.unique(np.concatenate([sets[k] for k in self.order]), return_inverse=True)
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        self.mark = np.zeros(len(values), np.int32)

    def linked(self, k: int) -> np.ndarray:
        x, at, size = int(self.place[k]), self.at, int(self.sizes[self.place[k]])
        # Others are too small or too large.
        low = int(np.searchsorted(self.sizes, -(-size * self.percent // 100), "left"))
        high = int(np.searchsorted(self.sizes, size * 100 // self.percent, "right"))
        own = self.flat[at[x] : at[x + 1]]
        self.mark[own] = 1
        inter = np.add.reduceat(self.mark[self.flat[at[low] : at[high]]], at[low:high] - at[low])
        self.mark[own] = 0
        hits = np.flatnonzero(100 * inter >= self.percent * (size + self.sizes[low:high] - inter)) + low
        return self.order[hits[hits != x]]


def _compared(rows: DataFrame, kind: type, bar: int) -> DataFrame:
    """Links ``(a, b)`` that join what hangs together in each block: where probes visit a block, theirs; else those of all members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in runs(batches, ["grp", "block"]):
            cid, probe, whole = (table.column(c).to_numpy() for c in ("cid", "probe", "n_blocks"))
            column, out = table.column("item"), []
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                asking = np.flatnonzero(probe[a:z])
                if z - a < 2 or (whole[a] > 1 and len(asking) == 0):
                    continue
                items = kind(column.slice(a, z - a).to_pylist(), bar)
                found = forest(z - a, items.linked, asking if whole[a] > 1 else None)
                # A member that visits its own block meets itself there.
                out += [(cid[a + x], cid[a + y]) for x, y in found if cid[a + x] != cid[a + y]]
            links = np.array(out, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    return rows.repartition("grp", "block").sortWithinPartitions("grp", "block").mapInArrow(run, "a long, b long")


def grouped_links(rows: DataFrame, kind: type, bar: int) -> DataFrame:
    """``(a, b)``: links that join what hangs together in each group of ``(grp, cid, n_blocks, item)``.

    A group with several blocks is compared in two rounds: all members with its hubs, then those that are not in
    its largest part by then, with all members.
    """
    own = F.pmod(F.xxhash64("cid"), F.col("n_blocks"))
    rows = rows.select("grp", "cid", "n_blocks", "item", own.alias("block"), F.lit(0).alias("probe"))
    large = rows.where("n_blocks > 1")
    if large.isEmpty():
        return _compared(rows, kind, bar)

    def visiting(members: DataFrame) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
        return members.select("grp", "cid", "n_blocks", "item", every.alias("block"), F.lit(1).alias("probe"))

    # Up to HUBS rows for each group of several blocks.
    hubs = cut(large.groupBy("grp", F.pmod(F.xxhash64("cid", F.lit(1)), F.lit(HUBS)).alias("slot")).agg(F.min("cid").alias("cid")).select("grp", "cid"))
    near = cut(_compared(large.unionByName(visiting(large.join(small(hubs), ["grp", "cid"]))), kind, bar))
    parts = components(near).withColumnsRenamed({"node": "cid", "component": "part"})
    placed = cut(large.select("grp", "cid").join(parts, "cid", "left").select("grp", "cid", F.coalesce("part", "cid").alias("part")))
    main = placed.groupBy("grp", "part").count().groupBy("grp").agg(F.max_by("part", F.struct("count", -F.col("part"))).alias("main"))
    apart = cut(placed.join(small(cut(main)), "grp").where("part <> main").select("grp", "cid"))
    others = visiting(large.join(small(apart), ["grp", "cid"], "left_semi"))
    return _compared(rows.unionByName(others), kind, bar).unionByName(near)


def _shingles(width: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in text_pieces(b)):
            sets = pa.array([s.tobytes() for s in shingle_sets(texts(batch), width)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("grp", "cid", "n_blocks")), sets], ["grp", "cid", "n_blocks", "item"])

    return make


def _listed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in (p for b in batches for p in text_pieces(b)):
        sets = list(shingle_sets(texts(batch), width))
        edges = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("cid"), lists], ["grp", "cid", "shingles"])


def refined(docs: DataFrame, members: DataFrame, classes: DataFrame, percent: int, width: int) -> DataFrame:
    """``members`` with families of several blocks split by their rarest shingles; members that share none with another one go.

    Of n shingles a set of the wanted similarity shares ``ceil(n * percent / 100)`` at least, so one of the ``n - that + 1`` rarest of its family
    is shared.  Shingles are counted per family, and the pairs of (family, rare shingle) tie members to each other: all of it
    is linear in the shingles.  The parts are refined again, as what is rare in a part is another matter, while that leaves half as much in large ones.
    """
    done, left = members.where("n_blocks = 1"), members.where("n_blocks > 1")
    load = lambda: left.groupBy("grp").agg(F.max("n_blocks").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    before = 2 * load()
    while (now := load()) and 2 * now <= before:
        before = now
        texts_of = docs.join(small(cut(left.select("grp", "cid"))), F.col("doc_id") == F.col("cid")).select("grp", "cid", "text")
        sets = cut(texts_of.mapInArrow(lambda batches: _listed(batches, width), "grp long, cid long, shingles array<long>"))
        tokens = sets.select("grp", "cid", F.explode("shingles").alias("token"))
        shared = cut(tokens.groupBy("grp", "token").agg(F.count("*").alias("n"), F.min("cid").alias("least")).where("n > 1"))
        held = tokens.join(shared, ["grp", "token"]).groupBy("grp", "cid").agg(F.sort_array(F.collect_list(F.struct("n", "token", "least"))).alias("held"))
        held = held.join(sets.select("grp", "cid", F.size("shingles").alias("size")), ["grp", "cid"])
        # Shingles of one member only are the rarest; what they leave of the first places goes to shared ones.
        places = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1 - (F.col("size") - F.size("held"))
        rare = held.where(places > 0).select("cid", F.explode(F.slice("held", F.lit(1), places.cast("int"))).alias("h"))
        parts = components(rare.select(F.col("cid").alias("a"), F.col("h.least").alias("b")))
        finer = parts.withColumnsRenamed({"node": "cid", "component": "grp"})
        sized = finer.join(classes.select("cid", "n_shingles"), "cid").groupBy("grp").agg(F.ceil(F.sum("n_shingles") / FAMILY_BLOCK).alias("n_blocks"))
        finer = cut(finer.join(cut(sized), "grp").select("grp", "cid", "n_blocks"))
        left = finer.where("n_blocks > 1")
        done = done.select("grp", "cid", "n_blocks").unionByName(finer.where("n_blocks = 1"))
    return cut(done.select("grp", "cid", "n_blocks").unionByName(left.select("grp", "cid", "n_blocks")))


def links(docs: DataFrame, classes: DataFrame, percent: int, width: int, coordinates: int) -> DataFrame:
    """Spanning links ``(a, b)`` among classes ``(cid, n_shingles, sig)`` of ``docs``, each confirmed on whole sets."""
    needed = matches_needed(coordinates, percent / 100)
    tokens = classes.select("cid", F.posexplode(_numbers(F.col("sig"), coordinates))).select("cid", F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("col")).alias("token"))
    shared = cut(tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"))
    ranked = tokens.join(shared, "token").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("held"))
    ranked = ranked.where(F.size("held") >= needed)
    posted = cut(ranked.select("cid", F.explode(F.slice("held", F.lit(1), F.size("held") - (needed - 1))).alias("h")).select("cid", "h.token"))
    lists = cut(posted.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token", F.ceil(F.col("n") / LIST_BLOCK).alias("n_blocks")))
    listed = posted.join(lists, "token").join(classes.select("cid", F.col("sig").alias("item")), "cid").withColumnRenamed("token", "grp")
    candidates = grouped_links(cut(listed.select("grp", "cid", "n_blocks", "item")), Signatures, needed)
    family = cut(components(candidates).withColumnsRenamed({"node": "cid", "component": "grp"}))
    sized = family.join(classes.select("cid", "n_shingles"), "cid").groupBy("grp").agg(F.ceil(F.sum("n_shingles") / FAMILY_BLOCK).alias("n_blocks"))
    members = refined(docs, cut(family.join(cut(sized), "grp")), classes, percent, width)
    whole = docs.join(small(members), F.col("doc_id") == F.col("cid")).select("grp", "cid", "n_blocks", "text")
    whole = whole.mapInArrow(_shingles(width), "grp long, cid long, n_blocks long, item binary")
    return grouped_links(cut(whole), Sets, percent)


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5, coordinates: int = COORDINATES) -> DataFrame:
    """Groups of documents linked by 100 * intersection >= percent * union of their shingle sets.

    ``docs`` has ``doc_id`` (long) and ``text``; other columns are ignored, whatever their names.
    Returns for every row ``doc_id, n_shingles, component_id, kept``: ``component_id`` is the least
    ``doc_id`` that can be reached over links, itself included; ``kept`` is ``doc_id = component_id``.

    A null or blank text has an empty set and is linked with nothing.  Rows that share a
    ``doc_id`` are one node.  A row with a null ``doc_id`` is linked with nothing: its component is
    null and it is kept.  An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = cut(sketches(docs, width, coordinates))
    classes = made.where("n_shingles > 0 and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("cid"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.count("*").alias("n"))
    classes = cut(classes)
    found = components(links(docs, classes, percent, width, coordinates))
    # A class of several documents, or one that is linked, leads to another component than its own id.
    target = classes.join(found, classes.cid == found.node, "left").select("fp", "cid", "n", F.coalesce("component", "cid").alias("component"))
    target = cut(target.where("n > 1 or component <> cid").select("fp", "component"))
    out = made.select("doc_id", "n_shingles", "fp").join(small(target), "fp", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 85, width: int = 5, coordinates: int = COORDINATES) -> DataFrame:
    """The rows of ``docs`` without the near-duplicates of another one: of each group the least ``doc_id`` stays.

    Of rows that share a ``doc_id`` one stays.  Rows with a null ``doc_id``, and texts without words, stay.
    Other columns are passed on, whatever their names; an empty table stays empty.
    """
    name = unused(docs.columns, "gone_") + "id"
    found = cut(near_duplicates(docs, percent, width, coordinates).select("doc_id", "kept"))
    gone = small(cut(found.where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()))
    rows = docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")
    shared = found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if shared.isEmpty():
        return rows
    return rows.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(rows.where("doc_id is null"))

"""SimHash near-duplicate detection by a self-join of binary tries.

1. Bit k of a document's fingerprint is 1 if it is set in over half of the XXH64 hashes of its word shingles.  Documents
   with equal fingerprints form a class, which its least ``doc_id`` stands for.
2. A binary trie over all fingerprints is joined with itself: a pair of nodes leads to the pairs of their children, each with
   the bits in which their paths differ, and a pair is dropped once that exceeds the budget.
3. Fingerprints within 2 bits of each other are equal in one of three blocks of 21 bits, whatever the differing bits
   are.  So there are three tries, each over the bits rotated by a block, and each has a budget of zero for its first 21 bits:
   these bits are what the fingerprints are shuffled by, and each of their values is the root of a subtrie of its own.
4. A subtrie of over ``SUBTRIE`` fingerprints is opened by Spark joins, eight levels at a time: pairs of nodes are joined with their
   children, differing bits add up, pairs beyond the budget are dropped, until the two subtries of a pair are
   small.  So no task has a hot subtrie whole; a node's fingerprints go to each pair that it is in.
5. Small pairs of subtries are descended within a task, all pairs of a level at once; pairs of single
   fingerprints compare the rest of their bits at once.  A task reports a spanning forest of the links that it finds, as
   components need no more.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import components, cut, runs, small, text_pieces, texts
from quillframe.llm.wordhash import LOWER

BITS = 64
SEED = 42
BUDGET = 2
#: Bits that are equal at the top of each rotated trie: of BUDGET + 1 blocks one has no differing bit.
EXACT = BITS // (BUDGET + 1)
#: Fingerprints of a pair of subtries that one task descends.
SUBTRIE = 8192
#: Levels that Spark opens at a time.
STEP = 8
#: Pairs of nodes that a task holds at a time.
FRONTIER = 1 << 18
_LOWER = LOWER.tobytes()


def shingle_hashes(text: bytes, width: int = 3) -> np.ndarray:
    """XXH64 of each shingle, repeats included; of the whole sequence where there are fewer words."""
    words = text.translate(_LOWER).split()
    flat = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(flat, SEED)] if words else [], dtype=np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(flat[a:z], SEED) for a, z in zip(starts, ends[width - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """The fingerprint as an unsigned number; 0 without hashes."""
    counts = np.zeros(BITS, np.int64)
    for part in np.array_split(hashes, len(hashes) // 65536 + 1):
        counts += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprinted(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(doc_id, code)`` for each row of ``(doc_id, text)``; the code is the fingerprint as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in text_pieces(b)):
            codes = np.array([fingerprint(shingle_hashes(t, width)) for t in texts(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(codes)], ["doc_id", "code"])

    return docs.mapInArrow(run, "doc_id long, code long")


class Forest:
    """Spanning edges of links among ``n`` items, found piece by piece."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def tie(self, one: np.ndarray, two: np.ndarray) -> None:
        root = self.root
        while (apart := root[one] != root[two]).any():
            one, two = one[apart], two[apart]
            np.minimum.at(root, np.maximum(root[one], root[two]), np.minimum(root[one], root[two]))
            while ((above := root[root]) != root).any():
                root[:] = above


def descend(codes: np.ndarray, pairs: np.ndarray, diff: np.ndarray, depth: int, forest: Forest, budget: int = BUDGET) -> None:
    """Ties the fingerprints within ``budget`` bits of each other, below pairs of trie nodes at one depth.

    ``codes`` are unsigned and sorted within each node; a node is the range of codes below it.  ``pairs`` has a row ``(a, b, c, d)`` for
    the nodes ``codes[a:b]`` and ``codes[c:d]``, equal ones for a node with itself.  Memory follows FRONTIER: of a larger
    frontier one half waits.
    """
    ones: dict[int, np.ndarray] = {}
    waiting = [(depth, pairs, diff)]
    while waiting:
        depth, pairs, diff = waiting.pop()
        if len(pairs) > FRONTIER:
            half = len(pairs) // 2
            waiting += [(depth, pairs[half:], diff[half:]), (depth, pairs[:half], diff[:half])]
            continue
        a, b, c, d = pairs.T
        own = a == c
        # Single fingerprints: the rest of their bits at once.
        leaves = (b - a == 1) & (d - c == 1)
        x, y = a[leaves & ~own], c[leaves & ~own]
        near = np.bitwise_count(codes[x] ^ codes[y]) <= budget
        forest.tie(x[near], y[near])
        inner = ~leaves
        if depth == BITS or not inner.any():
            continue
        a, b, c, d, own, diff = a[inner], b[inner], c[inner], d[inner], own[inner], diff[inner]
        if depth not in ones:
            bit = codes >> np.uint64(BITS - 1 - depth) & np.uint64(1)
            ones[depth] = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        upto = ones[depth]
        # Where the child of bit 1 begins in each of the two nodes.
        m, n = b - (upto[b] - upto[a]), d - (upto[d] - upto[c])
        kids = [(a, m, c, n, diff, None), (m, b, n, d, diff, None), (a, m, n, d, diff + 1, None), (m, b, c, n, diff + 1, ~own)]
        found = [], []
        for lo, hi, low, high, bits, allowed in kids:
            stays = (hi > lo) & (high > low) & (bits <= budget) & ((lo != low) | (hi - lo > 1))
            stays = stays if allowed is None else stays & allowed
            found[0].append(np.stack([lo[stays], hi[stays], low[stays], high[stays]], axis=1))
            found[1].append(bits[stays])
        waiting.append((depth + 1, np.concatenate(found[0]), np.concatenate(found[1])))


def _node(code: Column, depth: int) -> Column:
    return F.shiftrightunsigned(code, BITS - depth) if depth < BITS else code


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the pairs of subtries ``(rot, depth, u, v)`` whose members come as ``(code, cid)``."""
    for table, cuts in runs(batches, ["rot", "depth", "u", "v"]):
        depth, u, v, cid = (table.column(c).to_numpy() for c in ("depth", "u", "v", "cid"))
        codes = table.column("code").to_numpy().view(np.uint64)
        forest = Forest(len(codes))
        first, last = cuts[:-1], cuts[1:]
        for level in np.unique(depth).tolist():
            here = depth[first] == level
            start, end = first[here], last[here]
            one, two = u[start].view(np.uint64), v[start].view(np.uint64)
            # Members of v follow those of u, or are the same.
            belongs = np.concatenate([[0], np.cumsum((codes >> np.uint64(BITS - level) if level < BITS else codes) == np.repeat(u[first], last - first).view(np.uint64))])
            middle = start + belongs[end] - belongs[start]
            own = one == two
            pairs = np.stack([start, np.where(own, end, middle), np.where(own, start, middle), end], axis=1)
            whole = (pairs[:, 1] > pairs[:, 0]) & (pairs[:, 3] > pairs[:, 2])
            descend(codes, pairs[whole], np.bitwise_count(one ^ two).astype(np.int64)[whole], level, forest)
        low = np.flatnonzero(forest.root != np.arange(len(codes)))
        yield pa.RecordBatch.from_arrays([pa.array(cid[low]), pa.array(cid[forest.root[low]])], ["a", "b"])


def subtrie_pairs(items: DataFrame) -> list[tuple[int, DataFrame]]:
    """Pairs of subtries ``(rot, u, v)`` by depth, of at most SUBTRIE fingerprints together, that hold all links among ``items``."""
    depth = EXACT
    nodes = items.groupBy("rot", _node(F.col("code"), depth).alias("u")).agg(F.count("*").alias("load")).where("load > 1")
    pairs = cut(nodes.select("rot", "u", F.col("u").alias("v"), F.lit(0).alias("diff"), "load"))
    out = []
    while True:
        out.append((depth, pairs.where(F.col("load") <= SUBTRIE).select("rot", "u", "v")))
        large = pairs.where(F.col("load") > SUBTRIE)
        if depth == BITS or large.isEmpty():
            return out
        below = min(depth + STEP, BITS)
        size, mask = below - depth, F.lit((1 << below - depth) - 1)
        opened = large.select("rot", F.explode(F.array("u", "v")).alias("node")).distinct()
        kids = items.select("rot", _node(F.col("code"), depth).alias("node"), _node(F.col("code"), below).alias("kid")).join(small(cut(opened)), ["rot", "node"])
        kids = cut(kids.groupBy("rot", "node", "kid").agg(F.count("*").alias("n")))
        # The paths of two children differ in some of these bits more than their parents' do.
        flips = [x for x in range(1 << size) if x.bit_count() <= BUDGET]
        left = large.select("rot", F.col("u").alias("node"), "v", "diff").join(kids, ["rot", "node"])
        left = left.withColumn("flip", F.explode(F.array(*map(F.lit, flips)))).withColumn("diff", F.col("diff") + F.bit_count("flip")).where(F.col("diff") <= BUDGET)
        other = F.shiftleft("v", size).bitwiseOR(F.col("kid").bitwiseAND(mask).bitwiseXOR(F.col("flip").cast("long")))
        left = left.select("rot", "node", "v", "diff", F.col("kid").alias("one"), F.col("n").alias("n_one"), other.alias("kid"))
        both = left.join(kids.select("rot", F.col("node").alias("v"), "kid", F.col("n").alias("n_two")), ["rot", "v", "kid"])
        # A node with itself has each pair of children once, and a child of one fingerprint not with itself.
        both = both.where("node <> v or one < kid or (one = kid and n_one > 1)")
        pairs = cut(both.select("rot", F.col("one").alias("u"), F.col("kid").alias("v"), "diff", F.when(F.col("one") == F.col("kid"), F.col("n_one")).otherwise(F.col("n_one") + F.col("n_two")).alias("load")))
        depth = below


def links(classes: DataFrame) -> DataFrame:
    """Spanning links ``(a, b)`` among classes ``(cid, code)`` whose fingerprints differ, in at most BUDGET bits."""
    turned = [F.shiftleft("code", k * EXACT).bitwiseOR(F.shiftrightunsigned("code", BITS - k * EXACT)) if k else F.col("code") for k in range(BUDGET + 1)]
    items = cut(classes.select("cid", F.posexplode(F.array(*turned))).toDF("cid", "rot", "code"))
    met = []
    for depth, pairs in subtrie_pairs(items):
        visits = pairs.select("rot", "u", "v", F.explode(F.array_distinct(F.array("u", "v"))).alias("node"))
        own = items.withColumn("node", _node(F.col("code"), depth))
        met.append(own.join(visits, ["rot", "node"]).select("rot", F.lit(depth).alias("depth"), "u", "v", "code", "cid"))
    members = reduce(DataFrame.unionByName, met)
    keys = ["rot", "depth", "u", "v"]
    # Sorted as unsigned numbers: u's members first, where u is the one whose range begins lower.
    placed = members.withColumn("place", F.shiftrightunsigned("code", 1))
    return placed.repartition(*keys).sortWithinPartitions(*keys, "place", "code").drop("place").mapInArrow(_within, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``, linked at 2 or fewer differing bits.

    ``docs`` has ``doc_id`` (long) and ``text``; other columns are ignored, whatever their names.  The fingerprint has 16
    lower-case hex digits; ``component_id`` is the least ``doc_id`` that can be reached over links, itself included.

    A null or blank text has no shingle and the fingerprint zero, and is linked like any other.  Rows that share a ``doc_id``
    are one node, each with its own fingerprint.  A row with a null ``doc_id`` is linked with nothing: its component is null.
    An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = cut(fingerprinted(docs, width))
    known = made.where("doc_id is not null")
    classes = cut(known.groupBy("code").agg(F.min("doc_id").alias("cid"), F.count("*").alias("n")))
    # An id with several fingerprints ties their classes.
    several = known.groupBy("doc_id").agg(F.min("code").alias("least"), F.max("code").alias("most")).where("least <> most").select("doc_id")
    tied = known.join(several, "doc_id").join(classes, "code").select(F.col("doc_id").alias("a"), F.col("cid").alias("b"))
    found = components(links(classes.select("cid", "code")).unionByName(tied))
    target = classes.join(found, classes.cid == found.node, "left").select("code", "n", "cid", F.coalesce("component", "cid").alias("component"))
    # Only a class of several documents, or one that is linked, leads to another component than its own id.
    target = cut(target.where("n > 1 or component <> cid").select("code", "component"))
    out = made.join(small(target), "code", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), component.alias("component_id"))

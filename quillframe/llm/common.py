"""What the corpus operators share: cutting lineage, size-checked broadcasts, group streams, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if a count shows that it has at most this many narrow rows.
BROADCAST_ROWS = 400_000
#: Members of a group that are compared with all others first.
HUBS = 8
#: Wide rows: at most so many bytes of them.
BROADCAST_BYTES = 32 << 20
#: Edges that one task reduces to stars at a time.
PIECE_EDGES = 1 << 18


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: the session's checkpoint folder.

    Where a session in local mode names none (as in tests), a temporary folder is set.  On a cluster that is
    an error, as each executor would write to a disk of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("quillframe.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("quillframe.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/quillframe"


def cut(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Writes a DataFrame as a table in the shared folder and reads it back.

    Later jobs start from the files, so a lost executor costs only the tasks that it was running.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``cut`` has written, once nothing reads them any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, width: int = 0) -> DataFrame:
    """Marks a written table for broadcast if a count of it allows that; else leaves it to a shuffle.

    ``width`` is a row's size in bytes where rows aren't narrow.
    """
    return F.broadcast(df) if df.count() <= min(BROADCAST_ROWS, BROADCAST_BYTES // max(width, 1)) else df


def unused(names: Iterable[str], stem: str) -> str:
    """A prefix, made from ``stem``, that no name starts with; Spark takes names of either case for one."""
    stem = f"_{stem}"
    while any(n.lower().startswith(stem) for n in names):
        stem = f"_{stem}"
    return stem


def text_pieces(batch: pa.RecordBatch, most: int = 1 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each, so that memory follows bytes, not rows."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    total, start = np.cumsum(sizes), 0
    while start < len(sizes):
        stop = int(np.searchsorted(total, (total[start - 1] if start else 0) + most, "right"))
        stop = max(stop, start + 1)
        yield batch.slice(start, stop - start)
        start = stop


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of each text; null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches sorted by ``keys``: tables that hold whole groups, with the groups' boundaries (0 and the number of rows among them).

    Only the last group of a batch waits for the next batch, so memory is one batch and one group.
    """
    held: list[pa.RecordBatch] = []

    def edges(table: pa.Table) -> np.ndarray:
        change = np.zeros(max(table.num_rows - 1, 0), dtype=bool)
        for k in keys:
            values = table.column(k).to_numpy()
            change |= values[1:] != values[:-1]
        return np.flatnonzero(change) + 1

    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([*held, batch]).combine_chunks()
        cuts = edges(table)
        if len(cuts) == 0:
            held.append(batch)
            continue
        last = int(cuts[-1])
        yield table.slice(0, last), np.concatenate([[0], cuts])
        held = table.slice(last).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.array([0, table.num_rows])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ties every node of a piece of the edges ``(a, b)`` to the least node that it hangs together with in that piece."""

    def tied(piece: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(piece)
        nodes, ends = np.unique(np.concatenate([table.column(c).to_numpy() for c in ("a", "b")]), return_inverse=True)
        one, two = ends[: len(ends) // 2], ends[len(ends) // 2 :]
        root = np.arange(len(nodes))
        while (apart := root[one] != root[two]).any():
            one, two = one[apart], two[apart]
            np.minimum.at(root, np.maximum(root[one], root[two]), np.minimum(root[one], root[two]))
            while ((above := root[root]) != root).any():
                root = above
        low = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[low]), pa.array(nodes[root[low]])], ["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= PIECE_EDGES:
            yield tied(held)
            held = []
    if held:
        yield tied(held)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the edges ``(a, b)``: ``(node, component)``, the component being its least node.

    First each piece of PIECE_EDGES edges is reduced to stars within its task.  Then large-star and
    small-star steps alternate (each a grouped minimum and a join back, both of which Spark can split
    for a node with very many neighbours) until all edges are stars: no node is tied to two others, and none
    that is tied to another has one tied to it.  Every round is written to the shared folder.  Nulls and
    self-loops are ignored.
    """
    given = cut(edges.where("a is not null and b is not null and a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))
    pieces = given.count() // PIECE_EDGES + 1
    found = cut(given.coalesce(pieces).mapInArrow(_stars, "a long, b long").distinct())
    discard(given)
    while True:
        ties = found.select(F.col("a").alias("node"), F.col("b").alias("to"), F.lit(0).alias("held")).unionByName(found.select(F.col("b").alias("node"), F.lit(None).cast("long").alias("to"), F.lit(1).alias("held")))
        ties = ties.groupBy("node").agg(F.min("to").alias("low"), F.max("to").alias("high"), F.max("held").alias("held"))
        if ties.where("low is not null and (low <> high or held = 1)").isEmpty():
            break
        # Large star: every neighbour above u is tied to the least of u and its neighbours.
        both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.where("a <> b").distinct())
        # Small star: every neighbour not above u, and u itself, is tied to the least of them.
        lower = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        tied = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = cut(tied.unionByName(lower.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        discard(found, least, large, lower)
        found = after
    return found.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(found.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def forest(n: int, linked: Callable[[int], np.ndarray], probes: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning edges of the links among ``n`` items; ``linked(i)`` gives all items that ``i`` is linked with.

    A few hubs are asked first.  What hangs together with the hub of the largest part needn't be asked any
    more: links within that part add nothing, and those that lead out of it are found from the other
    end.  So where most items hang together, the work grows with their number and not with its
    square.  With ``probes``, only these are asked.
    """
    labels, out = np.arange(n), []

    def ask(i: int) -> None:
        hits = linked(i)
        held, first = np.unique(labels[hits], return_index=True)
        for lab, at in zip(held.tolist(), first.tolist(), strict=True):
            if lab != labels[i]:
                out.append((i, int(hits[at])))
                labels[labels == lab] = labels[i]

    if probes is not None:
        for i in probes.tolist():
            ask(i)
        return out
    hubs = np.unique(np.linspace(0, n - 1, min(n, HUBS)).astype(int)).tolist()
    for i in hubs:
        ask(i)
    main = max(hubs, key=lambda i: int((labels == labels[i]).sum()))
    for i in range(n):
        if labels[i] != labels[main] and i not in hubs:
            ask(i)
    return out

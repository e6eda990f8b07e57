"""Packing token sequences into windows with lexical neighbours.

1. Every document is tokenised once, and its ids are written as 16-bit numbers.
2. Whole windows of a long document stand alone; its rest goes to the pool.
3. If the pool has more than SHARD_TOKENS ids, it is dealt to shards of about that size by content.  A
   document is sent to the lists of its POSTED rarest terms; in each it meets the documents next to it in the
   order of their rarest terms, and the mate with the greatest idf of shared terms over all lists is linked
   with it.  What hangs together by links stays in one shard, beside what has the same rarest term.
4. Each shard has an inverted index from token ids to its documents with BM25 weights; document
   frequencies and the mean length are counted over the whole pool beforehand (one row per token
   id of the vocabulary).
5. A seed document opens a window.  Its unused neighbours, best score first, fill it; the last one is cut
   where the window ends, and what is left of it opens the next window.  So only the last window
   of a shard has padding.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillframe.llm.bpe import SpanEncoder, word_merges
from quillframe.llm.common import components, cut, runs, small, text_pieces
from quillframe.llm.pretokens import ragged, split_words

WINDOW = 2048
#: The id that ends every document.
END = 1
SHARD_TOKENS = 1_500_000
#: Terms by which a document is compared, those under which it is listed, and documents of a list that meet.
RARE, POSTED, LIST_BLOCK = 16, 8, 256
K1, B = 1.2, 0.75
#: Bits for the shards of a task in a sequence's number.
SHARD_BITS = 13
COMMON = 8
_PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_NAMES = [x.split()[0] for x in _PIECE.split(", ")]


def normal(text: str) -> str:
    """Composed and in lower case, each character on its own (a final sigma is a sigma)."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def token_ids(texts: list[str], encoder: SpanEncoder) -> list[np.ndarray]:
    """Ids of each text, followed by END."""
    data, starts, ends, per_text = split_words([normal(t) for t in texts])
    ids, counts = encoder(data, starts, ends)
    if len(ids) and int(ids.max()) >= 1 << 16:
        raise ValueError("the vocabulary has more than 65,536 ids")
    edge = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(per_text)])]
    return [np.append(ids[a:z], END).astype("<u2") for a, z in zip(edge[:-1], edge[1:], strict=True)]


@functools.cache
def word_encoder(path: str) -> SpanEncoder:
    """The encoder of a worker, with the words that its earlier tasks have met; its store is bounded."""
    return SpanEncoder(word_merges(path))


def tokenised(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, doc_tokens, deal, ids``; ``deal`` spreads rows evenly whatever their keys are."""
    path = path or public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, n = word_encoder(path), TaskContext.get().partitionId(), 0
        for batch in (p for b in batches for p in text_pieces(b, 2 << 20)):
            ids = token_ids([t or "" for t in batch.column("text").to_pylist()], encoder)
            deal = (np.int64(task) << np.int64(36)) + np.arange(n, n + len(ids))
            n += len(ids)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(deal), pa.array([x.tobytes() for x in ids], pa.binary())], ["doc_id", "doc_tokens", "deal", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, doc_tokens long, deal long, ids binary")


def _rows(batch: pa.RecordBatch | pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2") for x in batch.column("ids").to_pylist()]


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array([x.astype("<u4").tobytes() for x in columns[-1]], pa.binary())], _NAMES)


def _whole_windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in text_pieces(b, column="ids")):
            out = []
            for doc, total, deal, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "deal")), _rows(batch), strict=True):
                for k in range(total // window):
                    out.append((doc, k * window, window, total, None, 0, ids[k * window : (k + 1) * window]))
            yield _pieces(out)

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many rows of a piece of the input each id occurs."""
    for batch in (p for b in batches for p in text_pieces(b, column="ids")):
        n = np.zeros(1 << 16, np.int64)
        for ids in _rows(batch):
            n[np.unique(ids)] += 1
        terms = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(n[terms])], ["term", "n"])


def _rarest(rank: np.ndarray):
    """``(deal, size, terms)``: the RARE rarest terms of each row, rarest first, as 16-bit ranks that sort as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in text_pieces(b, column="ids")):
            rows = _rows(batch)
            size = np.array([len(x) for x in rows])
            key = np.unique(np.repeat(np.arange(len(rows)), size) << 16 | rank[np.concatenate(rows)])
            begin = np.searchsorted(key, np.arange(len(rows)) << 16)
            ranks = (key & 0xFFFF).astype(">u2")
            terms = [ranks[a:z][:RARE].tobytes() for a, z in zip(begin, [*begin[1:], len(key)], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("deal"), pa.array(size, pa.int64()), pa.array(terms, pa.binary())], ["deal", "size", "terms"])

    return run


def _mates(weight: np.ndarray):
    """``(a, b, score)``: for each row of a list the one of its block with the greatest weight of shared terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in runs(batches, ["listed"]):
            deal, terms, out = table.column("deal").to_numpy(), table.column("terms").to_pylist(), []
            for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                # Blocks of like size, so that none is a single row.
                edges = np.linspace(begin, end, -(-(end - begin) // LIST_BLOCK) + 1).astype(int).tolist()
                for a, z in zip(edges[:-1], edges[1:], strict=True):
                    if z - a < 2:
                        continue
                    row = np.repeat(np.arange(z - a), [len(x) // 2 for x in terms[a:z]])
                    held, at, times = np.unique(np.frombuffer(b"".join(terms[a:z]), ">u2"), return_inverse=True, return_counts=True)
                    held, at, row = held[times > 1], (np.cumsum(times > 1) - 1)[at[times[at] > 1]], row[times[at] > 1]
                    matrix = np.zeros((z - a, len(held)), np.float32)
                    matrix[row, at] = np.sqrt(weight[held])[at]
                    score = matrix @ matrix.T
                    np.fill_diagonal(score, -1)
                    best = score.argmax(axis=1)
                    out.append((deal[a:z], deal[a:z][best], score[np.arange(z - a), best].astype(np.float64)))
            columns = zip(*out, strict=True) if out else (np.zeros(0, t) for t in (np.int64, np.int64, np.float64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if out else c) for c in columns], ["a", "b", "score"])

    return run


def by_content(pool: DataFrame, idf: np.ndarray, shard_tokens: int) -> DataFrame:
    """``dealt, kind, shard, part`` of every row of ``pool``: rows that are linked, and then those with like rarest terms, share a shard."""
    order = np.argsort(-idf, kind="stable")
    rank = np.empty(1 << 16, np.int64)
    rank[order] = np.arange(1 << 16)
    rare = cut(pool.select("deal", "ids").mapInArrow(_rarest(rank), "deal long, size long, terms binary"))
    place = F.expr(f"explode(sequence(0, least({POSTED}, length(terms) div 2) - 1))").alias("place")
    lists = rare.where(F.length("terms") > 0).select("deal", "terms", place)
    lists = cut(lists.select(F.conv(F.hex(F.expr("substring(terms, cast(2 * place + 1 as int), 2)")), 16, 10).cast("long").alias("listed"), "terms", "deal"))
    # By range, so that a list of any length is spread.
    lists = lists.repartitionByRange("listed", "terms", "deal").sortWithinPartitions("listed", "terms", "deal")
    mates = lists.mapInArrow(_mates(idf[order]), "a long, b long, score double")
    best = mates.groupBy("a").agg(F.max_by("b", F.struct("score", -F.col("b"))).alias("b"))
    found = rare.join(components(best), F.col("deal") == F.col("node"), "left")
    found = cut(found.select("deal", "size", F.coalesce("component", "deal").alias("component"), F.substring("terms", 1, 2).alias("first")))
    sums = cut(found.groupBy("component").agg(F.sum("size").alias("tokens"), F.min("first").alias("first")))
    half = shard_tokens // 2
    # Of components with like first terms, in the order of these: at most one row per id of the vocabulary.
    groups = sums.where(F.col("tokens") <= half).groupBy("first").agg(F.sum("tokens").alias("in_group"))
    before = F.sum("in_group").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
    groups = cut(groups.withColumn("bin", F.floor(F.coalesce(before, F.lit(0)) / half)))
    spread = lambda tokens: F.greatest(F.lit(1), F.round(tokens / shard_tokens).cast("long"))
    large, common = F.col("tokens") > half, F.col("in_group") > half
    # Three kinds of shards: parts of a large component, parts of a common first term, and terms next to each other up to a shard's size.
    placed = sums.join(F.broadcast(groups), "first", "left").select(
        "component",
        F.when(large, 0).when(common, 1).otherwise(2).alias("kind"),
        F.when(large, F.col("component")).when(common, F.conv(F.hex("first"), 16, 10).cast("long")).otherwise(F.col("bin")).alias("shard"),
        F.when(large, spread(F.col("tokens"))).alias("parts"),
        F.when(~large & common, F.pmod(F.xxhash64("component"), spread(F.col("in_group")))).otherwise(0).alias("part"),
    )
    out = found.select("deal", "component").join(small(cut(placed)), "component")
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("deal"), "parts")).otherwise(F.col("part"))
    return cut(out.select(F.col("deal").alias("dealt"), "kind", "shard", part.alias("part")))


class Index:
    """BM25 weights of a shard's documents, by document and by term.

    The list of a term that one document in ``COMMON`` holds is a row of weights of all documents.
    """

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float):
        length = np.array([len(d) for d in docs])
        flat = np.concatenate(docs).astype(np.int64)
        key = np.repeat(np.arange(len(docs)), length) << 16 | flat
        key, times = np.unique(key, return_counts=True)
        self.doc, self.term = key >> 16, key & 0xFFFF
        norm = K1 * (1 - B + B * length / mean_length)
        weight = idf[self.term] * times * (K1 + 1) / (times + norm[self.doc])
        self.by_doc = np.searchsorted(self.doc, np.arange(len(docs) + 1))
        order = np.argsort(self.term.astype(np.uint16), kind="stable")
        self.posted, self.weight = self.doc[order], weight[order]
        self.by_term = np.searchsorted(self.term[order], np.arange((1 << 16) + 1))
        self.n = len(docs)
        size = np.diff(self.by_term)
        common = np.flatnonzero(size * COMMON > self.n)
        self.row = np.full(1 << 16, -1)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), self.n))
        at = ragged(self.by_term[common], size[common])
        self.rows[np.repeat(np.arange(len(common)), size[common]), self.posted[at]] = self.weight[at]

    def scores(self, doc: int) -> np.ndarray:
        """Scores of all documents of the shard for the terms of one."""
        terms = self.term[self.by_doc[doc] : self.by_doc[doc + 1]]
        rows = self.row[terms]
        terms = terms[rows < 0]
        at = ragged(self.by_term[terms], self.by_term[terms + 1] - self.by_term[terms])
        return self.rows[rows[rows >= 0]].sum(axis=0) + np.bincount(self.posted[at], self.weight[at], self.n)


def fill(lengths: np.ndarray, index: Index, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Windows of one shard as lists of ``(document, start, length)``; every id lies in one of them."""
    unused = np.ones(len(lengths), bool)
    seed, start, first = -1, 0, 0
    while True:
        if seed < 0:
            while first < len(lengths) and not unused[first]:
                first += 1
            if first == len(lengths):
                return
            seed, start = first, 0
            unused[seed] = False
        taken = [(seed, start, int(lengths[seed] - start))]
        room = window - taken[0][2]
        scores, most = None, 32
        while room > 0 and unused.any():
            if scores is None:
                scores = index.scores(seed)
            rest = np.flatnonzero(unused)
            # Enough of the best ones; twice as many each time if these are short.
            some = rest[np.argpartition(-scores[rest], most - 1)[:most]] if len(rest) > most else rest
            most *= 2
            for other in some[np.lexsort((some, -scores[some]))]:
                size = min(int(lengths[other]), room)
                taken.append((int(other), 0, size))
                unused[other] = False
                room -= size
                if room == 0:
                    break
        yield taken
        last, begun, size = taken[-1]
        # What is left of the one that was cut opens the next window.
        seed, start = (last, begun + size) if begun + size < lengths[last] else (-1, 0)


def _packed(window: int, idf: np.ndarray, mean_length: float):
    def pack_shard(shard: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = _rows(table)
        doc, total, begin = (table.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "start"))
        out: list[tuple] = []
        for n, taken in enumerate(fill(np.array([len(x) for x in ids]), Index(ids, idf, mean_length), window)):
            offset = 0
            for k, start, size in taken:
                out.append((doc[k], begin[k] + start, size, total[k], shard << 32 | n, offset, ids[k][start : start + size]))
                offset += size
            if len(out) > 4096:
                yield _pieces(out)
                out = []
        yield _pieces(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Shards are numbered by task, so that no order over all of them is needed.
        shard = TaskContext.get().partitionId() << SHARD_BITS
        for table, cuts in runs(batches, ["kind", "shard", "part"]):
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                yield from pack_shard(shard, table.slice(a, z - a))
                shard += 1

    return run


def packed(docs: DataFrame, window: int = WINDOW, path: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pieces of all documents, dealt to sequences of at most ``window`` ids.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored.  Returns per piece ``doc_id,
    start, length, doc_tokens, sequence_id, offset, ids`` (little-endian 32-bit numbers).  A null or
    empty text is the single id END.  Repeated rows are packed each on its own, a null ``doc_id`` is
    passed on, and an empty table gives an empty result.
    """
    made = cut(tokenised(docs, path))
    whole = made.where(F.col("doc_tokens") >= window)
    full = F.floor(F.col("doc_tokens") / window)
    pieces = whole.mapInArrow(_whole_windows(window), _PIECE)
    # Sequences of the shards have numbers below 2**62: tasks below 2**17, shards of a task, windows of a shard.
    pieces = pieces.withColumn("sequence_id", F.lit(1 << 62) + F.monotonically_increasing_id())
    pool = made.where(F.col("doc_tokens") % window > 0).withColumn("start", (full * window).cast("long"))
    pool = pool.withColumn("ids", F.expr("substring(ids, cast(2 * start + 1 as int))"))
    n, tokens = pool.agg(F.count("*"), F.sum(F.col("doc_tokens") - F.col("start"))).first()
    if not n:
        return pieces
    # One row per id of the vocabulary, which has fewer than 2**16.
    counts = pool.select("ids").mapInArrow(_frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    idf = np.zeros(1 << 16)
    held = np.array([r["n"] for r in counts])
    idf[[r["term"] for r in counts]] = np.log(1 + (n - held + 0.5) / (held + 0.5))
    if tokens <= shard_tokens:
        dealt = pool.withColumns({"kind": F.lit(2), "shard": F.lit(0).cast("long"), "part": F.lit(0).cast("long")})
    else:
        dealt = pool.join(small(by_content(pool, idf, shard_tokens)), F.col("deal") == F.col("dealt"))
    keys = ["kind", "shard", "part"]
    dealt = dealt.select(*keys, "deal", "doc_id", "doc_tokens", "start", "ids")
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys, "deal")
    return pieces.unionByName(dealt.mapInArrow(_packed(window, idf, tokens / n), _PIECE))


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their ids in place of these."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

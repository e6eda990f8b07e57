"""Byte-pair encoding with a segment tree per pre-token.

The leaves of a pre-token's tree are its byte positions.  A leaf holds the rank of the pair that the
symbol living there forms with the next living symbol, joined with the position, so that an inner
node's minimum is the leftmost pair of least rank below it.  A merge takes the root's pair and
updates three leaves (the merged symbol, its dead right half, and the living left neighbour), each in
logarithmic time.  Trees of equal height are kept as rows of one array and merge in step.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import text_pieces
from quillframe.llm.pretokens import ragged, split_gapless
from quillframe.llm.wordhash import distinct_spans

_NONE = np.int64(1) << np.int64(60)
_EMPTY = np.iinfo(np.int64).min
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Fewer rows than this don't merge in step, but one after another.
FEW_ROWS = 8


class Merges:
    """Which pairs of symbols merge, at which rank, into which symbol; and the symbols of single bytes."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]], byte_ids: np.ndarray, last_byte_ids: np.ndarray | None = None):
        keys = np.array([a << 32 | b for a, b in pairs], dtype=np.int64)
        # A table with open places: a pair stands at the place of its hash, or at the first free one after it.
        bits = max(len(pairs) * 8, 1).bit_length()
        self.shift = np.uint64(64 - bits)
        size = (1 << bits) + len(pairs) + 1
        self.keys = np.full(size, _EMPTY)
        self.ranks, self.ids = np.zeros(size, np.int32), np.zeros(size, np.int32)
        at, left = self._place(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == _EMPTY]
            put = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[put]] = keys[put]
            self.ranks[at[put]] = np.array([r for r, _ in pairs.values()], np.int32)[put]
            self.ids[at[put]] = np.array([i for _, i in pairs.values()], np.int32)[put]
            left = left[~np.isin(left, put)]
            at[left] += 1
        self.pairs = {a << 32 | b: x for (a, b), x in pairs.items()}
        self.byte_ids = byte_ids
        self.last_byte_ids = byte_ids if last_byte_ids is None else last_byte_ids

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _SPREAD) >> self.shift).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of pairs, and the merged symbols; a pair that doesn't merge has the rank _NONE."""
        key = (left << 32 | right).ravel()
        at = self._place(key)
        met = self.keys[at]
        other = np.flatnonzero((met != key) & (met != _EMPTY))
        while len(other):
            at[other] += 1
            met[other] = self.keys[at[other]]
            other = other[(met[other] != key[other]) & (met[other] != _EMPTY)]
        return np.where(met == key, self.ranks[at], _NONE).reshape(left.shape), self.ids[at].reshape(left.shape)


def _merge_rows(symbols: np.ndarray, lengths: np.ndarray, merges: Merges) -> np.ndarray:
    """Merges rows of symbols in step; dead and absent places come out as -1.

    ``symbols`` has a power of two of columns; row ``r`` holds ``lengths[r]`` symbols.
    """
    rows, width = symbols.shape
    place = np.arange(width)
    # Rows lie one after another; in ``live`` one column more on the right stands for "no symbol".
    following = np.where(place + 1 < lengths[:, None], place + 1, width).ravel()
    before = np.tile(place - 1, rows)
    live = np.concatenate([symbols, np.full((rows, 1), -1, np.int64)], axis=1)
    tree = np.full((rows, 2 * width), _NONE, dtype=np.int64)
    ranks, _ = merges.of(live[:, :-1], live[:, 1:])
    tree[:, width:] = np.where((ranks < _NONE) & (live[:, :-1] >= 0), ranks * width + place, _NONE)
    level = width
    while level > 1:
        level //= 2
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
    live, tree = live.ravel(), tree.ravel()
    active = np.flatnonzero(tree[1 :: 2 * width] < _NONE)
    while len(active):
        own, symbol, root = active * width, active * (width + 1), active * (2 * width)
        here = tree[root + 1] & (width - 1)
        dead = following[own + here]
        _, merged = merges.of(live[symbol + here], live[symbol + dead])
        merged = merged.astype(np.int64)
        live[symbol + here] = merged
        live[symbol + dead] = -1
        right = following[own + dead]
        following[own + here] = right
        inner = right < width
        before[(own + right)[inner]] = here[inner]
        left = before[own + here]
        some = np.flatnonzero(left >= 0)
        # The merged symbol with its right neighbour, and its left neighbour with it.
        rank, _ = merges.of(np.concatenate([merged, live[(symbol + left)[some]]]), np.concatenate([live[symbol + right], merged[some]]))
        at = np.concatenate([here, left[some]])
        value = np.where(rank < _NONE, rank * width + at, _NONE)
        node = width + np.concatenate([at, dead])
        base = np.concatenate([root, root[some], root])
        tree[(base + node)[: len(at)]] = value
        tree[(base + node)[len(at) :]] = _NONE
        while node[0] > 1:
            node >>= 1
            below = base + 2 * node
            tree[base + node] = np.minimum(tree[below], tree[below + 1])
        active = active[tree[root + 1] < _NONE]
    return live.reshape(rows, width + 1)[:, :-1]


def _merge_one(symbols: np.ndarray, merges: Merges) -> list[int]:
    """Merges the symbols of one pre-token, on a tree of plain numbers; for long ones that few others are like."""
    n = len(symbols)
    width = 1 << (n - 1).bit_length()
    none, get, live = int(_NONE), merges.pairs.get, symbols.tolist()
    following, before = list(range(1, n + 1)), list(range(-1, n - 1))
    ranks, _ = merges.of(symbols[:-1], symbols[1:])
    level = np.full(width, _NONE)
    level[: n - 1] = np.where(ranks < _NONE, ranks * width + np.arange(n - 1), _NONE)
    levels = [level]
    while len(level) > 1:
        level = np.minimum(level[::2], level[1::2])
        levels.append(level)
    tree = [none, *np.concatenate(levels[::-1]).tolist()]

    def put(node: int, value: int) -> None:
        while node and tree[node] != value:
            tree[node] = value
            other = tree[node ^ 1] if node > 1 else value
            value, node = min(value, other), node >> 1

    while (top := tree[1]) < none:
        here = top % width
        dead = following[here]
        live[here] = get(live[here] << 32 | live[dead])[1]
        live[dead] = -1
        right = following[here] = following[dead]
        put(width + dead, none)
        if right < n:
            before[right] = here
            found = get(live[here] << 32 | live[right])
            put(width + here, found[0] * width + here if found else none)
        else:
            put(width + here, none)
        left = before[here]
        if left >= 0:
            found = get(live[left] << 32 | live[here])
            put(width + left, found[0] * width + left if found else none)
    return [x for x in live if x >= 0]


def encode_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the byte spans one after another, and each span's number of symbols."""
    lengths = ends - starts
    counts = np.zeros(len(starts), dtype=np.int64)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    height = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
    for h in np.unique(height[lengths > 0]):
        mine = np.flatnonzero((height == h) & (lengths > 0))
        width = 1 << int(h)
        for rows in np.array_split(mine, len(mine) * width // (1 << 19) + 1):
            n = lengths[rows]
            symbols = np.full((len(rows), width), -1, np.int64)
            inside = np.arange(width) < n[:, None]
            symbols[inside] = merges.byte_ids[data[ragged(starts[rows], n)]]
            symbols[np.arange(len(rows)), n - 1] = merges.last_byte_ids[data[ends[rows] - 1]]
            if len(rows) < FEW_ROWS and width > 1:
                each = [_merge_one(s[:k], merges) for s, k in zip(symbols, n.tolist(), strict=True)]
                counts[rows] = [len(x) for x in each]
                parts.append((rows, np.concatenate(each)))
                continue
            done = _merge_rows(symbols, n, merges)
            counts[rows] = (done >= 0).sum(axis=1)
            parts.append((rows, done[done >= 0]))
    offsets = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), dtype=np.uint32)
    for rows, symbols in parts:
        out[ragged(offsets[rows], counts[rows])] = symbols
    return out, counts


class SpanEncoder:
    """Encodes spans, each distinct one once; keeps the distinct spans seen lately.

    The store is bounded: it starts anew beyond ``keep`` spans.  Spans are told apart by two
    independent 64-bit hashes.
    """

    def __init__(self, merges: Merges, keep: int = 500_000):
        self.merges, self.keep = merges, keep
        self._clear()

    def _clear(self) -> None:
        self.one, self.other, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.symbols = np.zeros(0, np.uint32)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all spans one after another, and each span's number of symbols."""
        if len(starts) == 0:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        first, inverse, one, other = distinct_spans(data, starts, ends)
        one, other = one[first], other[first]
        if len(self.one) > self.keep:
            self._clear()
        slot = np.minimum(np.searchsorted(self.one, one), max(len(self.one) - 1, 0))
        known = (self.one[slot] == one) & (self.other[slot] == other) if len(self.one) else np.zeros(len(one), bool)
        fresh = np.flatnonzero(~known)
        symbols, counts = encode_spans(data, starts[first[fresh]], ends[first[fresh]], self.merges)
        at, n = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
        at[known], n[known] = self.at[slot[known]], self.n[slot[known]]
        at[fresh], n[fresh] = len(self.symbols) + np.cumsum(counts) - counts, counts
        self.symbols = np.concatenate([self.symbols, symbols])
        if len(fresh):
            merged = np.concatenate([self.one, one[fresh]])
            order = np.argsort(merged, kind="stable")
            self.one, self.other = merged[order], np.concatenate([self.other, other[fresh]])[order]
            self.at, self.n = np.concatenate([self.at, at[fresh]])[order], np.concatenate([self.n, counts])[order]
        return self.symbols[ragged(at[inverse], n[inverse])], n[inverse]


@functools.cache
def rank_merges(path: str) -> tuple[Merges, np.ndarray, np.ndarray]:
    """Merges of a file of ranks, and its tokens' bytes one after another with their offsets."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    pairs = {}
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            left, right = ranks.get(token[:k]), ranks.get(token[k:])
            if left is not None and right is not None:
                pairs[left, right] = (rank, rank)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
    byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
    return Merges(pairs, byte_ids), np.frombuffer(b"".join(tokens), np.uint8), offsets


@functools.cache
def word_merges(path: str) -> Merges:
    """Merges of a tokenizer file with byte-level symbols and a mark on the last symbol of a word."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocab, suffix = model["vocab"], model["end_of_word_suffix"]
    # The usual byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, shift = [""] * 256, 0
    for b in range(256):
        letters[b] = chr(b) if b in printable else chr(256 + shift)
        shift += b not in printable
    pairs = {}
    for rank, pair in enumerate(model["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        pairs.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))
    return Merges(pairs, np.array([vocab[c] for c in letters]), np.array([vocab[c + suffix] for c in letters]))


def encode_and_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encodes whole texts and decodes the ids again.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored.  Returns for every row
    ``doc_id, ids (array<int>), decoded (binary)``.  A null text counts as empty: no ids, no bytes.  Repeated rows give repeated results;
    a null ``doc_id`` is passed on; an empty table gives an empty result.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, alphabet, offsets = rank_merges(path)
        encoder, sizes = SpanEncoder(merges), np.diff(offsets)
        for batch in (p for b in batches for p in text_pieces(b, 2 << 20)):
            data, starts, ends, per_text = split_gapless([t or "" for t in batch.column("text").to_pylist()])
            ids, counts = encoder(data, starts, ends)
            edge = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(per_text)])]
            decoded = alphabet[ragged(offsets[ids], sizes[ids])]
            bytes_at = np.concatenate([[0], np.cumsum(sizes[ids])])[edge]
            lists = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids.view(np.int32)))
            blobs = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(bytes_at.astype(np.int32)), pa.py_buffer(decoded)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, blobs], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of encoded documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat, edge = lists.values.to_numpy().astype("<u4", copy=False), lists.offsets.to_numpy()
            ids = [hashlib.sha256(flat[a:z]).hexdigest() for a, z in zip(edge[:-1], edge[1:], strict=True)]
            texts = [hashlib.sha256(x.as_buffer()).hexdigest() for x in batch.column("decoded")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(edge).astype(np.int64)), pa.array(ids), pa.array(texts)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

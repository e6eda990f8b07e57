"""Token counts under a unigram model, by dynamic programming over a trie of distinct pre-tokens.

A pre-token is a word with the word mark before it.  The distinct pre-tokens of a piece of text are
sorted, which lays them out as a trie: a word opens new nodes only beyond the prefix that it shares
with the word before.  The forward score of a node is the best score of any segmentation of its
prefix; it is computed once, from the nodes above it.  The first ``WIDEST`` levels go level by level, all
words in step; the few words that reach deeper are walked one after another, each from the
place where it leaves the one before.  At a word's last node the number of tokens of that
segmentation is its count, and a document's count is the sum over its words.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import text_pieces, texts
from quillframe.llm.wordhash import distinct_spans, mix, word_spans

MARK = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words of more characters are walked.
WIDEST = 48


class Pieces:
    """Pieces of a vocabulary file with log probabilities that follow their rank.

    The file gives an order of pieces, not probabilities; the n-th piece gets Zipf's
    ``-log((n + 2.7) * H)``.  A character outside the vocabulary costs one byte piece per byte.
    """

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        normal = [i for i in range(len(names)) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        rank = sorted(normal, key=lambda i: -model.get_score(i))
        norm = np.log(sum(1 / (n + 2.7) for n in range(len(rank))))
        self.scores = {names[i]: -float(np.log(n + 2.7) + norm) for n, i in enumerate(rank)}
        self.byte = -float(np.log(len(rank) + 2.7) + norm)
        self.longest = max(map(len, self.scores))
        keys = np.array([int(self.key(np.array([ord(c) for c in p], np.uint64))) for p in self.scores], np.uint64)
        order = np.argsort(keys)
        self.keys = np.concatenate([keys[order], [np.uint64(2**64 - 1)]])
        self.values = np.concatenate([np.array(list(self.scores.values()))[order], [0.0]])

    @staticmethod
    def key(points: np.ndarray) -> np.uint64:
        h = np.zeros(1, np.uint64)
        for p in points:
            h = h * _BASE + mix(np.array([p], np.uint64))
        return h[0]


@functools.cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _walked(words: list[str], model: Pieces) -> Iterator[int]:
    """Numbers of tokens of sorted words, walking the trie in depth: a node's forward score stays while words pass through it."""
    # Scores and numbers of tokens along the path of the word before.
    scores, counts, path = [0.0], [0], ""
    for word in words:
        shared = len(os.path.commonprefix([path, word]))
        del scores[shared + 1 :], counts[shared + 1 :]
        for d in range(shared + 1, len(word) + 1):
            n = len(word[d - 1].encode())
            best, tokens = scores[d - 1] + n * model.byte, counts[d - 1] + n
            for size in range(1, min(d, model.longest) + 1):
                score = model.scores.get(word[d - size : d])
                if score is not None:
                    score, number = score + scores[d - size], counts[d - size] + 1
                    if score > best or (score == best and number < tokens):
                        best, tokens = score, number
            scores.append(best)
            counts.append(tokens)
        path = word
        yield counts[-1]


def count_distinct(words: list[str], model: Pieces, widest: int = WIDEST) -> np.ndarray:
    """Numbers of tokens of distinct pre-tokens, sharing work along common prefixes."""
    out = np.zeros(len(words), np.int64)
    short = [k for k, w in enumerate(words) if len(w) <= widest]
    deep = sorted((k for k, w in enumerate(words) if len(w) > widest), key=words.__getitem__)
    out[deep] = list(_walked([words[k] for k in deep], model))
    if not short:
        return out
    strings = np.array([words[k] for k in short])
    order = np.argsort(strings, kind="stable")
    points = strings[order].view(np.uint32).reshape(len(short), -1).astype(np.uint64)
    length = np.array([len(words[k]) for k in short])[order]
    rows, depth = points.shape
    level = np.arange(1, depth + 1)
    # A node is new where the word differs from the one before it up to that depth.
    same = np.zeros((rows, depth), bool)
    same[1:] = np.logical_and.accumulate(points[1:] == points[:-1], axis=1)
    fresh = ~same & (level <= length[:, None])
    node = np.cumsum(fresh, axis=0) - 1
    prefix = np.zeros((rows, depth + 1), np.uint64)
    letters = mix(points)
    for d in range(depth):
        prefix[:, d + 1] = prefix[:, d] * _BASE + letters[:, d]
    power = np.cumprod(np.full(depth + 1, _BASE, np.uint64), dtype=np.uint64)
    scores, counts = [np.zeros(1)], [np.zeros(1, np.int64)]
    for d in range(1, depth + 1):
        first = np.flatnonzero(fresh[:, d - 1])
        last = points[first, d - 1]
        n = 1 + (last >= 0x80).astype(np.int64) + (last >= 0x800) + (last >= 0x10000)
        above = node[first, d - 2] if d > 1 else np.zeros(len(first), np.int64)
        best, tokens = scores[d - 1][above] + n * model.byte, counts[d - 1][above] + n
        for size in range(1, min(d, model.longest) + 1):
            key = prefix[first, d] - prefix[first, d - size] * power[size - 1]
            at = np.searchsorted(model.keys, key)
            above = node[first, d - size - 1] if d > size else np.zeros(len(first), np.int64)
            score = np.where(model.keys[at] == key, scores[d - size][above] + model.values[at], -np.inf)
            number = counts[d - size][above] + 1
            better = (score > best) | ((score == best) & (number < tokens))
            best, tokens = np.where(better, score, best), np.where(better, number, tokens)
        scores.append(best)
        counts.append(tokens)
    ends = np.zeros(rows, np.int64)
    for d in np.unique(length):
        mine = np.flatnonzero(length == d)
        ends[mine] = counts[d][node[mine, d - 1]]
    out[np.array(short)[order]] = ends
    return out


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_words, n_tokens`` for every row; words are runs outside ``[\\x20\\x09-\\x0D]``.

    A null or blank text has no words and no tokens.  Repeated rows give repeated results, a null
    ``doc_id`` is passed on, other columns are ignored, and an empty table gives an empty result.
    """
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in (p for b in batches for p in text_pieces(b, 2 << 20)):
            # A line break keeps the words of neighbouring texts apart.
            rows = texts(batch)
            data = np.frombuffer(b"\n".join(rows), np.uint8)
            starts, ends = word_spans(data)
            edge = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in rows)]))
            counts = np.zeros(0, np.int64)
            if len(starts):
                first, inverse, _, _ = distinct_spans(data, starts, ends)
                raw = data.tobytes()
                counts = count_distinct([MARK + raw[a:z].decode() for a, z in zip(starts[first], ends[first], strict=True)], model)[inverse]
            total = np.concatenate([[0], np.cumsum(counts)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(edge)), pa.array(np.diff(total[edge]))], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")

"""A quality classifier over word vectors by random indexing.

1. Every word falls into a bucket by its hash, and its shape (cases, length, signs at its end) into
   another.  A bucket's index vector has a few entries of +1 or -1.  A word's context vector is the
   sum of the index vectors of its neighbours and their shapes, added up over all texts.
2. The context vectors, divided by their counts, centred and scaled to length one, are the word vectors.
3. A text is pooled: mean and spread of its words' vectors, and mean absolute step between neighbours.
4. A network of two layers is trained on a bounded sample of labelled texts that are not held out;
   a temperature fitted on a part set aside calibrates its probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import text_pieces, texts
from quillframe.llm.wordhash import LOWER, mix, span_hashes, word_spans

BUCKETS = 1 << 14
WIDTH = 24
#: Entries of an index vector, and neighbours on either side.
ENTRIES, REACH = 2, 2
#: At most so many labelled texts are learnt from.
TRAIN_ROWS = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 256, 3e-3, 1e-4
FOLDS, HELD_OUT = 3, 1

_U = np.uint64


def words_of(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bucket and shape bucket of the words of all texts one after another, and each text's number of words."""
    data = np.frombuffer(b"\n".join(rows), np.uint8)
    starts, ends = word_spans(data)
    per_text = np.diff(np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in rows)])))
    if len(starts) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), per_text
    word = (span_hashes(LOWER[data], starts, ends) % _U(BUCKETS)).astype(np.int64)
    shape = np.zeros(len(starts), _U)
    for low, high in ((65, 91), (97, 123), (48, 58), (128, 256)):
        total = np.concatenate([[0], np.cumsum((data >= low) & (data < high))])
        count = total[ends] - total[starts]
        # None, one, several, all.
        kind = np.minimum(count, 2) + (count == ends - starts)
        shape = shape * _U(5) + kind.astype(_U)
    sign = lambda b: np.where((b < 48) | ((b > 57) & (b < 65)) | ((b > 90) & (b < 97)) | ((b > 122) & (b < 128)), b, 0)
    length = np.minimum(ends - starts, 12) // 3
    for part in (length, sign(data[starts]), sign(data[ends - 1]), sign(data[np.maximum(ends - 2, starts)])):
        shape = shape * _U(131) + part.astype(_U)
    return word, (mix(shape) % _U(BUCKETS)).astype(np.int64), per_text


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of every bucket's index vector, words first, then shapes."""
    rng = np.random.default_rng(11)
    return rng.integers(0, WIDTH, (2 * BUCKETS, ENTRIES)), rng.choice([-1, 1], (2 * BUCKETS, ENTRIES))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(bucket, n, v0, v1, ...)``: context vectors of all words, added up over a task."""
    place, sign = index_vectors()
    total, number = np.zeros(2 * BUCKETS * WIDTH), np.zeros(2 * BUCKETS, np.int64)
    for batch in (p for b in batches for p in text_pieces(b, 2 << 20)):
        word, shape, per_text = words_of(texts(batch))
        text = np.repeat(np.arange(len(per_text)), per_text)
        shape = shape + BUCKETS
        number += np.bincount(word, minlength=2 * BUCKETS) + np.bincount(shape, minlength=2 * BUCKETS)
        for step in range(1, REACH + 1):
            if len(word) <= step:
                continue
            near = np.flatnonzero(text[step:] == text[:-step])
            for own, other in ((near, near + step), (near + step, near)):
                for source in (word[other], shape[other]):
                    for k in range(ENTRIES):
                        for kind in (word, shape):
                            total += np.bincount(kind[own] * WIDTH + place[source, k], sign[source, k], 2 * BUCKETS * WIDTH)
    used = np.flatnonzero(number)
    rows = total.reshape(-1, WIDTH)[used].astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(number[used]), *(pa.array(c) for c in rows.T)], ["bucket", "n", *_VALUES])


_VALUES = [f"v{k}" for k in range(WIDTH)]


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Vectors of all buckets, learnt from all texts; 2 * BUCKETS rows, whatever the size of the input."""
    text = docs.select(F.col("text").cast("string").alias("text"))
    parts = text.mapInArrow(_contexts, f"bucket long, n long, {', '.join(f'{v} long' for v in _VALUES)}")
    out, number = np.zeros((2 * BUCKETS, WIDTH)), np.zeros(2 * BUCKETS)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n"), *(F.sum(v).alias(v) for v in _VALUES)).collect():
        out[r["bucket"]], number[r["bucket"]] = r[2:], r["n"]
    # The mean context of all words says nothing about any.
    out = out / np.maximum(number, 1)[:, None] - out.sum(axis=0) / max(number.sum(), 1)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(length > 0, length, 1)).astype(np.float32)


def pooled(rows: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Features of texts; one without words has zeros."""
    word, shape, per_text = words_of(rows)
    out = np.zeros((len(rows), 3 * WIDTH + 1), np.float32)
    filled = np.flatnonzero(per_text)
    if len(filled) == 0:
        return out
    edge = (np.cumsum(per_text) - per_text)[filled]
    n = per_text[filled][:, None]
    values = vectors[word] + vectors[shape + BUCKETS]
    mean = np.add.reduceat(values, edge, axis=0) / n
    spread = np.sqrt(np.maximum(np.add.reduceat(values * values, edge, axis=0) / n - mean * mean, 0))
    step = np.zeros_like(values)
    step[1:] = np.abs(values[1:] - values[:-1])
    step[edge] = 0
    out[filled] = np.concatenate([mean, spread, np.add.reduceat(step, edge, axis=0) / n, np.log1p(n) / 10], axis=1)
    return out


@dataclass
class Network:
    """Two layers, after scaling of the features; ``temperature`` divides the last layer's output."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.maximum((x - self.mean) / self.scale @ w1 + b1, 0) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x).astype(np.float64) / self.temperature, -50, 50)))


def trained(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Network:
    """Fits the network with Adam on four fifths of the rows, and the temperature on the rest.

    With no rows, or labels all alike, the result is a constant near the labels' mean.
    """
    rng = np.random.default_rng(seed)
    width = x.shape[1]
    net = Network(x.mean(axis=0) if len(x) else np.zeros(width), (x.std(axis=0) if len(x) else np.zeros(width)) + 1e-3, [])
    share = (y.sum() + 1) / (len(y) + 2)
    net.weights = [rng.normal(0, np.sqrt(2 / width), (width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.array(np.log(share / (1 - share)))]
    if len(np.unique(y)) < 2:
        return net
    net.weights[2] = rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN)
    deal = rng.permutation(len(x))
    fit, hold = deal[len(x) // 5 :], deal[: len(x) // 5]
    first, second = [np.zeros_like(w) for w in net.weights], [np.zeros_like(w) for w in net.weights]
    best, kept, step = np.inf, net.weights, 0

    def loss(rows: np.ndarray, temperature: float = 1.0) -> float:
        z = net.logit(x[rows]) / temperature
        return float(np.mean(np.logaddexp(0, z) - y[rows] * z))

    for _ in range(EPOCHS):
        order = rng.permutation(fit)
        for a in range(0, len(order), BATCH):
            rows = order[a : a + BATCH]
            z = (x[rows] - net.mean) / net.scale
            inner = z @ net.weights[0] + net.weights[1]
            hidden = np.maximum(inner, 0)
            error = (1 / (1 + np.exp(-np.clip(hidden @ net.weights[2] + net.weights[3], -50, 50))) - y[rows]) / len(rows)
            back = np.outer(error, net.weights[2]) * (inner > 0)
            slopes = [z.T @ back, back.sum(axis=0), hidden.T @ error, error.sum()]
            step += 1
            for k, g in enumerate(slopes):
                g = g + DECAY * net.weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                net.weights[k] = net.weights[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        if len(hold) and (now := loss(hold)) < best:
            best, kept = now, list(net.weights)
    net.weights = kept
    if len(hold):
        options = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        net.temperature = float(min(options, key=lambda t: loss(hold, t)))
    return net


def fold(doc_id: Column) -> Column:
    """Remainder of the CRC-32 of an id as text."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % FOLDS


def learnt(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, Network]:
    """Word vectors of all texts, and a network trained on labelled ones outside the held-out fold.

    If more than TRAIN_ROWS are labelled, those with the least hashes of their ids are taken.  Rows
    with a null id or label are no examples; of several labels for an id the greatest counts.
    """
    vectors = word_vectors(docs)
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("label")).where("doc_id is not null and label is not null")
    named = named.where(fold(F.col("doc_id")) != HELD_OUT).groupBy("doc_id").agg(F.max("label").alias("label"))
    # Bounded by TRAIN_ROWS, so it may be broadcast.
    some = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id")

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in text_pieces(b, 2 << 20)):
            blobs = [x.astype("<f4").tobytes() for x in pooled(texts(batch), vectors)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(blobs, pa.binary())], ["doc_id", "label", "x"])

    found = rows.mapInArrow(pool, "doc_id long, label double, x binary").dropDuplicates(["doc_id"]).orderBy("doc_id").limit(TRAIN_ROWS).collect()
    x = np.array([np.frombuffer(r["x"], "<f4") for r in found], np.float32).reshape(-1, 3 * WIDTH + 1)
    return vectors, trained(x, np.array([float(r["label"] >= 0.5) for r in found]))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    ``labels`` has ``doc_id`` and ``quality`` (0 or 1).  A null or empty text has the score of a text without words.
    Repeated rows get equal scores; a row with a null id is not held out; an empty table gives an
    empty result.
    """
    vectors, net = learnt(docs, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in text_pieces(b, 2 << 20)):
            values = net.score(pooled(texts(batch), vectors))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(values, pa.float64()), pa.array((values >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")

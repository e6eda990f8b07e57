"""Quality rules whose strictness follows the record of the host that a document comes from.

Each document is measured once per pass, in Arrow batches.  The first pass counts, per host, how many
documents fail a strict rule (a grouped sum, so a host with a third of all rows costs no more than
another).  The hosts' rates are shrunk towards a beta prior fitted to all hosts by moments.  The
second pass joins the verdict back: a trusted host's documents meet the lenient limits, an
untrusted host's the strict ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.llm.common import cut, small, text_pieces, texts, unused
from quillframe.llm.wordhash import IS_SPACE, joined, span_hashes, windows, word_spans

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_shouted"]
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class Limits:
    """Percentages beyond which a document fails."""

    symbols: int
    shouted: int
    dup_lines: int
    repeats: int


LENIENT = Limits(symbols=30, shouted=60, dup_lines=50, repeats=20)
STRICT = Limits(symbols=10, shouted=30, dup_lines=30, repeats=10)
UNTRUSTED = 0.5
MIN_WORDS = 10
MAX_REPEATS = 20


def _alike(text: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of those that share a text and a hash with another one, group by group, and each one's group."""
    order = np.lexsort((hashes, text))
    same = (hashes[order][1:] == hashes[order][:-1]) & (text[order][1:] == text[order][:-1])
    shared = np.append(same, False) | np.append(False, same)
    group = np.cumsum(np.append(True, ~same)) if len(order) else np.zeros(0, np.int64)
    return order[shared], group[shared]


def measures(rows: list[bytes]) -> np.ndarray:
    """The measures of texts, one row for each; zeros for an empty one."""
    data, edges = joined(rows)
    starts, ends = word_spans(data)
    n = len(rows)
    out = np.zeros((n, len(MEASURES)), np.int64)
    if len(starts) == 0:
        return out
    text = np.searchsorted(edges, starts, "right") - 1
    per = lambda rows_of, weights=None: np.bincount(rows_of, weights, n)
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[np.minimum(edges, len(data))])
    out[:, 0] = per(text)
    out[:, 1] = total(((data & 0xC0) != 0x80) & ~IS_SPACE[data])
    out[:, 2] = total(_SYMBOL[data])
    breaks = np.flatnonzero(data == 10)
    begin, end = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(data)]])
    filled = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end = begin[filled], end[filled]
    line = np.searchsorted(edges, begin, "right") - 1
    out[:, 3] = per(line)
    at, group = _alike(line, span_hashes(data, begin, end))
    # Lines of equal hashes are compared whole; the first of its kind is no repeat.
    raw, met = data.tobytes(), set()
    for k, g in zip(at.tolist(), group.tolist(), strict=True):
        key = (g, raw[begin[k] : end[k]])
        out[line[k], 4] += key in met
        met.add(key)
    if len(starts) >= 5:
        whole = np.flatnonzero(text[4:] == text[:-4])
        at, group = _alike(text[whole], windows(span_hashes(data, starts, ends), 5)[whole])
        if len(at):
            # Windows of equal hashes must be equal under a second, independent hash.
            at = whole[at]
            at = at[_alike(group, windows(span_hashes(data, starts, ends, 1), 5)[at])[0]]
        step = np.bincount(at, minlength=len(starts) + 5) - np.bincount(at + 5, minlength=len(starts) + 5)
        out[:, 5] = per(text, np.cumsum(step)[: len(starts)] > 0)
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    lower = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
    out[:, 6] = per(text, (upper[ends] - upper[starts] > 1) & (lower[ends] == lower[starts]))
    return out


def measured(docs: DataFrame, prefix: str = "") -> DataFrame:
    """``docs`` with its columns, of which ``text`` is read, followed by the measures."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in text_pieces(b)):
            rows = measures(texts(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c) for c in rows.T)], [*names, *(prefix + m for m in MEASURES)])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(prefix + m, T.LongType()) for m in MEASURES)]))


def over(limits: Limits, prefix: str = "") -> Column:
    """Does a measured document exceed one of the limits?"""
    m = {name: F.col(prefix + name) for name in MEASURES}
    return (
        (100 * m["n_symbols"] > limits.symbols * m["n_words"])
        | (100 * m["n_shouted"] > limits.shouted * m["n_words"])
        | (100 * m["n_dup_lines"] > limits.dup_lines * m["n_lines"])
        | (100 * m["n_repeat_words"] > limits.repeats * m["n_words"])
    )


def base_failed(prefix: str = "") -> Column:
    words, repeats = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (words < MIN_WORDS) | (100 * repeats > MAX_REPEATS * words)


def prior(hosts: int, total: int, failed: int, squares: float, sizes: float) -> tuple[float, float]:
    """Mean and strength; ``squares`` is the sum of failures ** 2 / n over hosts, ``sizes`` that of n ** 2."""
    mean = failed / total if total else 0.0
    chance = mean * (1 - mean)
    if hosts < 2 or chance == 0:
        return mean, 1e4
    # Expected without differences: chance * (hosts - 1); each unit of variance adds total - sizes / total.
    spread = (squares - total * mean * mean - chance * (hosts - 1)) / (total - sizes / total)
    return mean, min(max(chance / spread - 1, 1.0), 1e4) if spread > 0 else 1e4


def host_verdicts(rows: DataFrame, prefix: str = "") -> DataFrame:
    """``(host, n, failures, rate, untrusted)`` per host of measured rows with a column ``host``.

    The prior's mean and strength come from the hosts' rates by moments, weighted by their documents:
    the variance of the rates, less what documents drawn at random would give them, is ``v``, and the
    strength is ``m (1 - m) / v - 1``, held between 1 and 10,000; with one host, or hosts no further
    apart than chance, 10,000.  So hosts of one document each don't pass for hosts that differ.
    """
    failed = (over(STRICT, prefix) | base_failed(prefix)).cast("long")
    counts = cut(rows.select("host", failed.alias("f")).groupBy("host").agg(F.count("*").alias("n"), F.sum("f").alias("failures")))
    n, f = F.col("n").cast("double"), F.col("failures").cast("double")
    hosts, total, failed, squares, sizes = counts.agg(F.count("*"), F.sum("n"), F.sum("failures"), F.sum(f * f / n), F.sum(n * n)).first()
    mean, strength = prior(hosts, total or 0, failed or 0, squares or 0.0, sizes or 0.0)
    rate = (F.col("failures") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    return counts.select("host", "n", "failures", rate.alias("rate"), (rate >= UNTRUSTED).alias("untrusted"))


def host_key(host: str) -> Column:
    """A null host counts as the host ''."""
    return F.coalesce(F.col(host).cast("string"), F.lit(""))


def decided(rows: DataFrame, verdicts: DataFrame, host: Column, prefix: str = "") -> DataFrame:
    """Measured rows with ``base_failed`` and ``kept``.

    Only untrusted hosts are joined back; their number is counted, and they are broadcast if few.
    """
    bad = small(cut(verdicts.where("untrusted").select(F.col("host").alias(prefix + "bad_host"))))
    rows = rows.withColumn(prefix + "host_of", host).join(bad, F.col(prefix + "host_of") == F.col(prefix + "bad_host"), "left")
    strictly = F.col(prefix + "bad_host").isNotNull() & over(STRICT, prefix)
    rows = rows.withColumns({prefix + "base_failed": base_failed(prefix), prefix + "kept": ~(base_failed(prefix) | over(LENIENT, prefix) | strictly)})
    return rows.drop(prefix + "host_of", prefix + "bad_host")


def verdicts_of(docs: DataFrame, host: str = "source") -> DataFrame:
    """``doc_id``, the measures, ``base_failed`` and ``kept`` for every row of ``docs``.

    The measures are written once and read by both passes.  A null text counts as empty and fails;
    a null host is the host ''.  Repeated rows are judged alike; a null ``doc_id`` is passed on; an
    empty table gives an empty result; other columns are ignored.
    """
    rows = cut(measured(docs.select(F.col("doc_id").cast("long"), host_key(host).alias("host"), F.col("text").cast("string"))).drop("text"))
    return decided(rows, host_verdicts(rows), F.col("host"))


def keep_good(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of ``docs`` that ``verdicts_of`` keeps, with their own columns only, whatever their names.

    Texts are measured once for the hosts' record and once for the verdict, so that they never
    travel.  Null and empty texts go, as they have too few words; a null host is the host '';
    repeated rows stay or go together, null ids don't matter, and an empty table stays empty.
    """
    prefix = unused(docs.columns, "rule_")
    record = measured(docs.select(host_key(host).alias("host"), F.col("text").cast("string")))
    rows = decided(measured(docs, prefix), host_verdicts(record), host_key(host), prefix)
    return rows.where(F.col(prefix + "kept")).select(*docs.columns)

"""Splitting texts into pre-tokens with numpy, many documents at a time.

Code points are classed as letters, numbers, white space and others; pre-tokens follow from
where the classes change.  The rules are those of two public tokenizer patterns:

* ``split_gapless``: ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
* ``split_words``: ``'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+``, the rest removed.
"""

from __future__ import annotations

import functools

import numpy as np
import regex

LETTER, NUMBER, SPACE, OTHER, EDGE = 0, 1, 2, 3, 4


@functools.cache
def class_table() -> np.ndarray:
    """The class of every code point."""
    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
    every = "".join(map(chr, points))
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for run in regex.finditer(pattern, every):
            table[points[run.start() : run.end()]] = kind
    return table


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts with an edge before, between and after them; classes; the edges' places."""
    points = np.frombuffer(("\0" + "\0".join(texts) + "\0").encode("utf-32-le"), np.uint32)
    edges = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    kinds = class_table()[points]
    kinds[edges] = EDGE
    return points, kinds, edges


def _byte_places(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where each code point's UTF-8 bytes start, edges having none; with the end of all."""
    width = np.ones(len(points), np.uint8)
    for least in (0x80, 0x800, 0x10000):
        width += points >= least
    width[edges] = 0
    byte = np.zeros(len(points) + 1, np.int64)
    np.cumsum(width, out=byte[1:])
    return byte


def _contractions(points: np.ndarray, kinds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the apostrophes ``at``, which start a contraction, and the length of its letters."""
    first = points[np.minimum(at + 1, len(points) - 1)]
    second = points[np.minimum(at + 2, len(points) - 1)]
    length = np.zeros(len(at), np.int64)
    length[np.isin(first, [ord(c) for c in "stmd"])] = 1
    for a, b in ("re", "ve", "ll"):
        length[(first == ord(a)) & (second == ord(b))] = 2
    return at[length > 0], length[length > 0]


def split_gapless(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pre-tokens that together cover each text.

    Returns the UTF-8 bytes of the texts one after another, the pre-tokens' starts and ends in
    these, and the number of pre-tokens in each text.
    """
    points, kinds, edges = _points(texts)
    change = np.flatnonzero(kinds[1:] != kinds[:-1]) + 1
    start = np.zeros(len(points), dtype=bool)
    start[change] = True
    # White space before something else gives its last character away: a blank to what follows,
    # any other as a pre-token of its own.
    last = change[(kinds[change - 1] == SPACE) & (kinds[change] != EDGE)] - 1
    start[last] = True
    attached = last[points[last] == 32] + 1
    start[attached] = False
    # A contraction can start only where an apostrophe starts a pre-token.
    quotes = change[(points[change] == 39) & (kinds[change] == OTHER)]
    quotes, length = _contractions(points, kinds, quotes[start[quotes]])
    start[quotes + 1] = False
    start[quotes + 1 + length] = True
    start[edges] = False
    at = np.flatnonzero(start)
    byte = _byte_places(points, edges)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    per_text = np.diff(np.searchsorted(at, edges))
    starts = byte[at]
    return data, starts, np.concatenate([starts[1:], [len(data)]]) if len(starts) else starts, per_text


def split_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters, single numbers, runs of others and contractions; white space is left out."""
    points, kinds, edges = _points(texts)
    start = np.zeros(len(points) + 1, dtype=bool)
    start[1:-1] = kinds[1:] != kinds[:-1]
    start[:-1] |= kinds == NUMBER
    quotes = np.flatnonzero(start[:-1] & (points == 39) & (kinds == OTHER))
    quotes, length = _contractions(points, kinds, quotes)
    start[quotes + 1] = False
    start[quotes + 1 + length] = True
    start[edges] = True
    at = np.flatnonzero(start[:-1])
    ends = np.concatenate([at[1:], [len(points)]])
    word = kinds[at] < SPACE
    word |= kinds[at] == OTHER
    at, ends = at[word], ends[word]
    byte = _byte_places(points, edges)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    return data, byte[at], byte[ends], np.diff(np.searchsorted(at, edges))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges ``start .. start + length``, one after another."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)

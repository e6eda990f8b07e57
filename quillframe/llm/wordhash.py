"""64-bit hashes of words, lines and word windows, computed with numpy one piece of text at a time.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``.  A span is hashed eight bytes at a time, every
step followed by an avalanche, so that no structure of the bytes can cancel out; a long span is
hashed by BLAKE2.  Equal spans have equal hashes on every executor.  Two different spans
collide with a chance of about 2**-64; hashes under two seeds are independent, so where equality
decides a result, both are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_STEP = _U(0xD6E8FEB86659FD93)
#: Spans of more bytes are hashed one by one.
LONG = 128

#: For each byte: is it white space, and its ASCII lower case.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Keeps the first 0 to 8 bytes of a little-endian number.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche step: spreads every input bit over the whole word; no two inputs have the same result."""
    h = h ^ (h >> _U(32))
    h *= _STEP
    h ^= h >> _U(29)
    h *= _BASE
    h ^= h >> _U(32)
    return h


def eights(data: np.ndarray) -> np.ndarray:
    """For each byte the number that its eight bytes from there on make; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words of a document's bytes."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~IS_SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of the byte spans ``data[start:end]``; spans may be of any kind (words, lines)."""
    if len(starts) == 0:
        return np.zeros(0, _U)
    loads = eights(data)
    length = ends - starts
    first = loads[starts] & _KEEP[np.minimum(length, 8)]
    out = mix(first ^ mix(length.astype(_U) + _U(seed << 40)))
    rows = np.flatnonzero((length > 8) & (length <= LONG))
    done = 8
    while len(rows):
        left = length[rows] - done
        out[rows] = mix(out[rows] ^ (loads[starts[rows] + done] & _KEEP[np.minimum(left, 8)]))
        rows, done = rows[left > 8], done + 8
    salt = seed.to_bytes(8, "little")
    for k in np.flatnonzero(length > LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8, salt=salt).digest(), "little")
    return out


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which span stands for each distinct one, the number of each span's own, and both hashes of all spans."""
    one, other = span_hashes(data, starts, ends), span_hashes(data, starts, ends, 1)
    _, first, inverse = np.unique(one, return_index=True, return_inverse=True)
    if (other[first][inverse] != other).any():
        _, first, inverse = np.unique(np.stack([one, other], axis=1), axis=0, return_index=True, return_inverse=True)
    return first, inverse, one, other


def word_hashes(text: bytes, lower: bool = False) -> np.ndarray:
    """Hashes of a document's words in order."""
    data = np.frombuffer(text, dtype=np.uint8)
    if lower:
        data = LOWER[data]
    starts, ends = word_spans(data)
    return span_hashes(data, starts, ends)


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` consecutive words; none if there are fewer words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, _U(width), dtype=np.uint64)
    for k in range(width):
        out = mix(out) + words[k : k + n]
    return mix(out)


def joined(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, a line end between them, and each text's start, with one more at the end."""
    return np.frombuffer(b"\n".join(rows), np.uint8), np.cumsum([0, *(len(r) + 1 for r in rows)])


def shingle_sets(rows: list[bytes], width: int = 5) -> Iterator[np.ndarray]:
    """For each document its sorted distinct shingle hashes in ASCII lower case.

    A document with fewer than ``width`` words has its whole word sequence as the only shingle;
    one without words, or null, has none.
    """
    data, edges = joined(rows)
    data = LOWER[data]
    starts, ends = word_spans(data)
    words = span_hashes(data, starts, ends)
    all_windows = windows(words, width)
    at = np.searchsorted(starts, edges).tolist()
    for a, z in zip(at[:-1], at[1:], strict=True):
        if z - a >= width:
            yield np.unique(all_windows[a : z - width + 1])
        else:
            yield windows(words[a:z], z - a) if z > a else words[:0]


def shingle_set(text: bytes | None, width: int = 5) -> np.ndarray:
    return next(shingle_sets([text or b""], width))

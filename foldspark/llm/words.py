"""Words of whole texts as 64-bit hashes, a batch at a time in numpy.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r; A-Z are lower-cased first. Hashes are polynomials over
a random byte table, finished by a mixer; equal words get equal hashes in every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_R = U(0x9E3779B97F4A7C15)  # odd, so powers can be inverted
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text whose hashes are worked out at once, at some 40 bytes of a worker's memory each; a longer text is a slice of its own.
SLICE = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
_BYTE[65:91] = _BYTE[97:123]
_powers: list[np.ndarray] = [np.ones(1, dtype=U), np.ones(1, dtype=U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse, mod 2**64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, SLICE + 1)
        inverse = U(pow(int(_R), -1, 1 << 64))
        for i, base in enumerate((_R, inverse)):
            table = np.full(size, base, dtype=U)
            table[0] = 1
            _powers[i] = np.cumprod(table, dtype=U)
    return _powers[0], _powers[1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return (offsets - offsets[0]) if len(column) else np.zeros(1, np.int64), data


def slices(offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``size`` bytes."""
    row = 0
    while row < len(offsets) - 1:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, end
        row = end


def word_spans(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of consecutive texts; a text's edge ends a word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = word[edges]
    last[edges - 1] = word[edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words before each text): texts i's words are hashes[n[i]:n[i + 1]]."""
    start, end = word_spans(offsets, data)
    up, down = _power_tables(len(data))
    total = np.zeros(len(data) + 1, dtype=U)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U)), np.searchsorted(start, offsets)


def batches_of_words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, hashes, words before each row) of runs of rows."""
    offsets, data = text_bytes(column)
    for a, b in slices(offsets):
        own = offsets[a : b + 1]
        yield a, b, *word_hashes(own - own[0], data[own[0] : own[-1]])


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; with fewer words the whole sequence is one, without words none."""
    n = len(words)
    if n == 0:
        return np.zeros(0, dtype=U)
    width = min(n, k)
    s = words[: n - width + 1] + U(width)
    for j in range(1, width):
        s = mix(s * U(0x9FB21C651E98DF25) + words[j : n - width + 1 + j])
    s = np.sort(mix(s))
    return s[np.concatenate(([True], s[1:] != s[:-1]))]

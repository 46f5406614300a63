"""Rolling hashes of bytes and words over Arrow columns of texts, in numpy.

A hash of bytes ``[s, e)`` is a polynomial over random byte values modulo 2**64, from prefix sums,
divided by the power at ``s`` so that it does not depend on the place, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import SPACE_BYTES

#: Bytes of text that are hashed at a time; a longer text is hashed whole.
SLICE_BYTES = 1 << 18

_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACE_BYTES)] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer: every bit of the result depends on every bit of ``x``."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=4)
def _byte_values(lane: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F + 2 * lane)) | np.uint64(1)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n-1 and their inverses modulo 2**64; kept up to a slice's length."""
    have = _powers.get(lane)
    if have is None or len(have[0]) < n:
        n = max(n, SLICE_BYTES + 1)
        base = _BASES[lane]
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, np.uint64(b))
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = tuple(both)
        if n <= 8 * SLICE_BYTES:
            _powers[lane] = have
    return have[0][:n], have[1][:n]


def prefix(data: np.ndarray, lane: int = 0) -> np.ndarray:
    """Prefix sums whose differences are hashes, see :func:`spans`."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_values(lane)[data] * powers(len(data), lane)[0][: len(data)], out=out[1:])
    return out


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hashes of the byte ranges [start, end)."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums), lane)[1][starts])


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of texts; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type in (pa.string(), pa.large_string()):
        column = pc.fill_null(column, "")
    binary = column.cast(pa.large_binary())
    offsets = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1]
    data = np.frombuffer(binary.buffers()[2], np.uint8) if binary.buffers()[2] is not None else np.empty(0, np.uint8)
    a = 0
    while a < len(binary):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, table: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes, first word of each text and the end) of the words.

    ``table`` tells the bytes of words; texts never share a word.
    """
    if lower:
        data = _LOWER[data]
    inside = table[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = inside[1:] & ~(inside[:-1] & ~cut[1:-1])
    if len(data):
        edge[0] = inside[0]
    starts = np.flatnonzero(edge[:-1])
    stop = np.zeros(len(data) + 1, bool)
    if len(data):
        stop[1:-1] = inside[:-1] & ~(inside[1:] & ~cut[1:-1])
        stop[-1] = inside[-1]
    ends = np.flatnonzero(stop)
    return starts, ends, spans(prefix(data), starts, ends), np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first shingle of each text and the end) of runs of ``n`` words.

    A text with 1 to n-1 words has its whole sequence as one shingle; one without words has none.
    """
    counts = np.diff(first)
    own = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    begins = np.concatenate([[0], np.cumsum(own)])
    # place of each shingle's first word
    at = np.arange(begins[-1]) + np.repeat(first[:-1] - begins[:-1], own)
    width = np.repeat(np.minimum(counts, n), own)
    total = np.zeros(len(at), np.uint64)
    for j in range(n):
        present = width > j
        if present.all():
            total = total * np.uint64(0x9FB21C651E98DF25) + hashes[at + j]
        else:
            total = np.where(present, total * np.uint64(0x9FB21C651E98DF25) + hashes[np.minimum(at + j, max(len(hashes) - 1, 0))], total)
    return mix(total + width.astype(np.uint64)), begins


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)

"""Vectorised text kernel on Arrow buffers.

Works on the UTF-8 bytes of whole string columns: words are found with a
256-entry class table, hashed in lanes of eight bytes, and grouped into shingles
without creating a Python object per word. A batch is cut
into chunks of about CHUNK bytes, so the memory of a task is bounded by that or
by its longest single document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_U = np.uint64


def class_table(separators: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(is_word, lowered) tables of 256 entries; A-Z are lowered, other bytes stay."""
    word = np.ones(256, bool)
    word[list(separators)] = False
    return word, np.frombuffer(bytes(range(256)).lower(), np.uint8)


#: words `[^\x20\x09-\x0D]+`
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
#: words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lowered: digits, a-z and all that is not ASCII
NON_ALNUM = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def seeds(n: int, of: int = 1) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + mix(np.array([of], _U)))


def chunks(column: pa.Array, limit: int = CHUNK):
    """Yields (first row, bytes, offsets) for runs of rows of about `limit` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """(starts, ends, row of each word) of the words of all rows of a chunk."""
    n = len(data)
    w = is_word[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = w[:-1]
    before &= ~edge[:n]
    after = np.zeros(n, bool)
    after[:-1] = w[1:]
    after &= ~edge[1:]
    starts = np.flatnonzero(w & ~before)
    ends = np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


_LANE = 8
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(_LANE)] + [(1 << 64) - 1], _U)
_STEP, _FIRST = _U(0x9E3779B97F4A7C15), _U(0x5851F42D4C957F2D)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lowered: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; equal words have equal hashes.

    A word is read in lanes of eight bytes. Each lane, tied to its place, goes
    through the finaliser before lanes are added up, so that no algebra between
    the bytes of a word survives (a polynomial modulo 2**64 gives some long words
    equal hashes whatever its base).
    """
    if not len(starts):
        return np.empty(0, _U)
    padded = np.zeros(len(data) + _LANE, np.uint8)
    padded[: len(data)] = lowered[data]
    lanes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    size = ends - starts
    many = np.maximum((size + _LANE - 1) // _LANE, 1)
    first = np.cumsum(many) - many
    if len(starts) == int(many.sum()):
        at, left, place = starts, size, _FIRST
    else:
        k = np.arange(int(many.sum())) - np.repeat(first, many)
        at, left = np.repeat(starts, many) + _LANE * k, np.repeat(size, many) - _LANE * k
        place = mix(k.astype(_U) * _STEP + _FIRST)
        place[k == 0] = _FIRST
    mixed = mix((lanes[at] & _KEEP[np.minimum(left, _LANE)]) ^ place)
    if len(mixed) > len(starts):
        mixed = np.add.reduceat(mixed, first)
    return mix(mixed + size.astype(_U) * _STEP)


def row_counts(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n)


def shingle_sets(words: np.ndarray, rows: np.ndarray, n: int, k: int):
    """Distinct k-word shingle hashes by row: (hashes, bounds); a row of fewer, but not none, is one shingle."""
    counts = row_counts(rows, n)
    first = np.concatenate(([0], np.cumsum(counts)))
    factors = seeds(k, 11)
    total = np.zeros(max(0, len(words) - k + 1), _U)
    for j in range(k):
        total += words[j : len(words) - k + 1 + j] * factors[j]
    total = mix(total)
    sets = []
    for i in range(n):
        a, c = first[i], counts[i]
        if c >= k:
            sets.append(np.unique(total[a : a + c - k + 1]))
        elif c:
            with np.errstate(over="ignore"):
                short = words[a : a + c] * factors[:c]
            sets.append(mix(np.array([short.sum(dtype=_U) + _U(c)], _U) ^ _U(0xD6E8FEB86659FD93)))
        else:
            sets.append(np.empty(0, _U))
    return (np.concatenate(sets) if sets else np.empty(0, _U)), np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)

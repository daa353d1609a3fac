"""Vectorised text primitives shared by the text operators.

Everything here works on Arrow string buffers with numpy, so Python never
handles one word at a time.  Words are maximal runs of bytes other than
0x20 and 0x09-0x0D; as those are ASCII, UTF-8 needs no decoding.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document forms a piece of its own.
PIECE_BYTES = 1 << 20

# glibc raises its limit for separate mappings as arrays are freed and then keeps their
# memory; fixed limits let a worker give large arrays back between tasks
try:
    _libc = ctypes.CDLL(None)
    _libc.mallopt(-3, 16 << 20)  # M_MMAP_THRESHOLD
    _libc.mallopt(-1, 32 << 20)  # M_TRIM_THRESHOLD
except (OSError, AttributeError):
    _libc = None


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes that no letter run holds: ASCII other than letters.
NOT_LETTER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])

_rng = np.random.default_rng(20240917)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_GRAM = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GRAM2 = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POS = mix(np.arange(1, 257, dtype=np.uint64) * _STEP) | np.uint64(1)


def _positions(n: int) -> np.ndarray:
    global _POS
    if n > len(_POS):
        _POS = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * _STEP) | np.uint64(1)
    return _POS


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    kind = np.int64 if wide else np.int32
    if offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with at most `limit` bytes in the column, or one row."""
    text = batch.column(batch.schema.get_field_index(column))
    _, offs = buffers(text)
    n, at = len(offs) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        end = min(end, n)
        yield batch.slice(at, end - at)
        at = end


def words(data: np.ndarray, offs: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and where each document's words begin.

    `space` marks the bytes between words.  The third array has one entry per document and a last one: document i has
    the words first[i]..first[i+1]-1.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    is_word = ~space[data]
    edge = np.empty(len(data) + 1, bool)
    edge[1:-1] = is_word[1:] != is_word[:-1]
    edge[0] = edge[-1] = True
    inner = offs[1:-1]
    edge[inner] = True
    cut = np.flatnonzero(edge)
    run = is_word[cut[:-1]]
    starts, ends = cut[:-1][run], cut[1:][run]
    return starts, ends, np.searchsorted(starts, offs).astype(np.int64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word; `lower` folds A-Z first."""
    return prefix_hashes(data, starts, ends, (), lower)[0]


def prefix_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lengths: tuple[int, ...], lower: bool = False) -> list[np.ndarray]:
    """Hashes of the words, then of their first k bytes for each k; a shorter word stands for itself."""
    table = _BYTE_LOWER if lower else _BYTE
    out = [np.empty(len(starts), np.uint64) for _ in range(1 + len(lengths))]
    at, n = 0, len(starts)
    while at < n:
        end = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE_BYTES, "right")))
        lo = starts[at]
        s, e = starts[at:end] - lo, ends[at:end] - lo
        chunk = data[lo : lo + e[-1]]
        place = np.arange(len(chunk), dtype=np.int64)
        place -= np.repeat(s, np.diff(np.append(s, len(chunk))))
        longest = int(place.max(initial=0)) + 1
        value = table[chunk] * _positions(longest)[place]
        acc = np.empty(len(chunk) + 1, np.uint64)
        acc[0] = 0
        np.cumsum(value, out=acc[1:])
        base = acc[s]
        out[0][at:end] = mix((acc[e] - base) + (e - s).astype(np.uint64) * _STEP)
        for j, k in enumerate(lengths):
            cut = np.minimum(e, s + k)
            out[j + 1][at:end] = mix((acc[cut] - base) + (cut - s).astype(np.uint64) * _STEP)
        at = end
    return out


def grams(h: np.ndarray, n: int, second: bool = False) -> np.ndarray:
    """Hashes of all runs of n consecutive entries of h (document ends ignored)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    coef = _GRAM2 if second else _GRAM
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out += h[j : j + len(out)] * coef[j]
    return mix(out)


def starts_inside(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the runs of n words that lie within one document, and each one's document."""
    count = np.maximum(np.diff(first) - n + 1, 0)
    doc = np.repeat(np.arange(len(count)), count)
    before = np.cumsum(count) - count
    index = np.arange(len(doc)) - np.repeat(before, count) + np.repeat(first[:-1], count)
    return index, doc


def slide_min_at(h: np.ndarray, w: int) -> np.ndarray:
    """For each start of w consecutive entries, the index of the first smallest."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.arange(len(h), dtype=np.int64)
    span, best = 1, at
    while span * 2 <= w:
        a, b = best[: len(best) - span], best[span:]
        best = np.where(h[b] < h[a], b, a)
        span *= 2
    if span < w:
        a, b = best[:n], best[w - span : w - span + n]
        best = np.where(h[b] < h[a], b, a)
    return best[:n]


def split_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, nulls as empty."""
    data, offs = buffers(column)
    raw, at = data.tobytes(), offs.tolist()
    return [raw[i:j] for i, j in zip(at, at[1:])]


def binary_array(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())

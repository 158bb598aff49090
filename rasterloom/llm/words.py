"""Vectorised word splitting and hashing of Arrow string columns.

A word is a maximal run of bytes other than space and U+0009 to U+000D, with A-Z
lower-cased; that equals ``[^\\x20\\x09-\\x0D]+`` on the text, as UTF-8 never uses
those bytes inside a longer character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time; a longer text is handled alone.
CHUNK = 1 << 20
#: Bytes from which on a span is hashed by itself.
LONG_SPAN = 512


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed)) | np.uint64(1)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The low bytes of eight, by their number.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_BY_SIZE = constants(LONG_SPAN + 1, 4711)


def text_chunks(col: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows with about limit bytes; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    n = len(col)
    if not n:
        return
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_spans(data: np.ndarray, off: np.ndarray, sep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the index of its first word (one more at the end)."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    sep = _SPACE[data] if sep is None else sep
    before, after = np.empty_like(sep), np.empty_like(sep)
    before[0] = after[-1] = True
    before[1:], after[:-1] = sep[:-1], sep[1:]
    before[off[:-1][off[:-1] < len(data)]] = True
    inner = off[1:]
    after[inner[inner > 0] - 1] = True
    starts, ends = np.flatnonzero(~sep & before), np.flatnonzero(~sep & after) + 1
    return starts, ends, np.searchsorted(starts, off)


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, for all but the last eight places."""
    return np.ndarray((len(raw) - 7,), "<u8", np.ascontiguousarray(raw), strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of the byte spans, with A-Z lower-cased if fold: eight bytes at a time into a state that is mixed after each."""
    if not len(starts):
        return np.empty(0, np.uint64)
    raw = np.concatenate([_LOWER[data] if fold else data, np.zeros(8, np.uint8)])
    eight = eights(raw)
    size = ends - starts
    out = mix(_BY_SIZE[np.minimum(size, LONG_SPAN)] ^ (eight[starts] & MASKS[np.clip(size, 0, 8)]))
    rest, k = np.flatnonzero((size > 8) & (size <= LONG_SPAN)), 8
    while len(rest):
        out[rest] = mix(out[rest] ^ (eight[starts[rest] + k] & MASKS[np.minimum(size[rest] - k, 8)]))
        k += 8
        rest = rest[size[rest] > k]
    for i in np.flatnonzero(size > LONG_SPAN):
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each text the index of its first word (one more at the end)."""
    starts, ends, first = word_spans(data, off)
    return span_hashes(data, starts, ends), first


def runs(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of size consecutive hashes; the last size - 1 places have no run."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9FB21C651E98DF25) + h[k : k + n]
    return mix(out)


def shingles(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the size-word shingles of each text and each text's first; a shorter text has itself as the only one."""
    whole = runs(h, size)
    counts = np.diff(first)
    per = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    at = np.zeros(len(per) + 1, np.int64)
    np.cumsum(per, out=at[1:])
    out = np.empty(at[-1], np.uint64)
    full = np.repeat(counts >= size, per)
    where = np.arange(at[-1]) - np.repeat(at[:-1], per) + np.repeat(first[:-1], per)
    out[full] = whole[where[full]]
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        out[at[i]] = runs(h[first[i] : first[i + 1]], int(counts[i]))[0]
    return out, at


def signed(h: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return h.view(np.int64)


def give_back() -> None:
    """Return freed memory to the system: a worker process outlives its tasks, and its allocator keeps what they freed."""
    import ctypes

    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass

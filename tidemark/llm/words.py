"""Vectorised word and shingle hashing over Arrow text columns.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``; lower-casing touches A-Z only. All hashes are 64-bit:
a polynomial over random byte values (prefix sums and modular inverses of an odd base, so every word of a chunk is hashed by
a handful of numpy passes), then an avalanche step. Equal words always get equal hashes on every machine and Python version.

Null texts count as empty. A chunk holds whole documents of about ``CHUNK`` bytes, or a single longer document, so the memory
a task needs is bounded by the chunk or by its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_WORDS = 0xC2B2AE3D27D4EB4F | 1
_MASK = (1 << 64) - 1


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Avalanche of 64-bit values; different salts give independent hashes."""
    h = h + U((salt * 0xA24BAED4963EE407 + 0x632BE59BD9B4E019) & _MASK)
    h ^= h >> U(30)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


_BYTES = mix(np.arange(256, dtype=U), 7)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTES_LOWER = _BYTES[_LOWER]
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    got = _powers.get(base)
    if got is None or len(got[0]) < n:
        size = max(n, CHUNK + 1)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.empty(size, dtype=U)
            p[0], have, step = 1, 1, b
            while have < size:
                take = min(have, size - have)
                p[have : have + take] = p[:take] * U(step)
                step, have = step * step & _MASK, have + take
            out.append(p)
        got = (out[0], out[1])
        if size <= 4 * CHUNK:
            _powers[base] = got
    return got


def rolling(w: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k values; position i covers w[i:i+k]. Shorter inputs give none."""
    if len(w) < k:
        return np.empty(0, dtype=U)
    p, inv = powers(_BASE_WORDS, len(w) + 1)
    cum = np.zeros(len(w) + 1, dtype=U)
    np.cumsum(w * p[: len(w)], out=cum[1:])
    return mix((cum[k:] - cum[:-k]) * inv[: len(w) - k + 1], k)


def spans(buf: np.ndarray, offsets: np.ndarray, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and each document's first word (one more entry than documents)."""
    if not len(buf):
        none = np.empty(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    is_sep = sep[buf]
    start = ~is_sep
    end = start.copy()
    start[1:] &= is_sep[:-1]
    end[:-1] &= is_sep[1:]
    lo, hi = offsets[:-1], offsets[1:]
    full = hi > lo
    start[lo[full]] = ~is_sep[lo[full]]
    end[hi[full] - 1] = ~is_sep[hi[full] - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def prefix_sums(buf: np.ndarray, lower: bool = True) -> np.ndarray:
    cum = np.zeros(len(buf) + 1, dtype=U)
    np.cumsum((_BYTES_LOWER if lower else _BYTES)[buf] * powers(_BASE, len(buf) + 1)[0][: len(buf)], out=cum[1:])
    return cum


def span_hashes(cum: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hashes of byte spans from prefix sums over their buffer."""
    return mix((cum[ends] - cum[starts]) * powers(_BASE, len(cum))[1][starts], salt)


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets into them) of a string or binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    off = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, dtype=np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b, raw[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def documents(column: pa.Array, lower: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, first word of each document and one past the last) by chunk."""
    for a, _, buf, off in chunks(column):
        starts, ends, first = spans(buf, off)
        yield a, span_hashes(prefix_sums(buf, lower), starts, ends), first


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each row; fewer words: the whole sequence as one; no words: empty."""
    for _, w, first in documents(column, True):
        grams = rolling(w, k)
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if hi - lo >= k:
                yield np.unique(grams[lo : hi - k + 1])
            elif hi > lo:
                yield rolling(w[lo:hi], hi - lo)
            else:
                yield np.empty(0, dtype=U)

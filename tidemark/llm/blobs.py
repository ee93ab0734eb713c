"""Hash records on their way between tasks: packed by bucket, so that a shuffle moves few large rows.

A map task appends (hash, owner) records; every ``FLUSH`` records they are dealt by the top bits of the hash into as many rows
as there are buckets. Hashes are cut to 32 bits below the bucket; equal hashes meet in one row group by group, and unequal ones
that agree in those bits are told apart by the exact step that follows.
"""

from __future__ import annotations

import numpy as np

FLUSH = 1 << 20
U = np.uint64


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def low_bits(h: np.ndarray) -> np.ndarray:
    """32 bits that the bucket leaves open."""
    return (h ^ (h >> U(29))).astype(np.uint32)


def deal(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the records by bucket (stable), and where each bucket begins."""
    b = bucket_of(h, buckets)
    b = b.astype(np.uint16) if buckets <= 1 << 16 else b
    order = np.argsort(b, kind="stable")
    return order, np.searchsorted(b[order], np.arange(buckets + 1))

"""Vectors as whole numbers: each component c becomes floor(scale * c), packed into bytes.

A packed vector is one byte that tells the width of an entry (2, 4 or 8 bytes, the least that holds all of its entries) and then the
entries, little-endian. Equal vectors have equal bytes. Null and empty vectors and those with a null or non-finite component are left out;
entries beyond 64 bits raise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2.0**62


def entries(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that are usable, offsets of their entries, all their entries as int64) of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    some = np.flatnonzero(pc.is_valid(column).to_numpy(zero_copy_only=False))
    column = column.take(pa.array(some))
    values, offsets = column.values, column.offsets.to_numpy()
    values = values.slice(offsets[0], offsets[-1] - offsets[0]) if len(offsets) else values
    offsets = offsets - offsets[0] if len(offsets) else offsets
    flat = values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    size = np.diff(offsets)
    good = (size > 0) & (bad[offsets[1:]] == bad[offsets[:-1]])
    keep = np.repeat(good, size)
    x = np.floor(scale * flat[keep])
    if len(x) and np.abs(x).max() >= LIMIT:
        raise ValueError("components beyond 64-bit whole numbers")
    return some[good], np.concatenate([[0], np.cumsum(size[good])]).astype(np.int64), x.astype(np.int64)


def width(x: np.ndarray) -> int:
    low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    return next(w for w in (2, 4, 8) if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)


def pack(x: np.ndarray) -> bytes:
    w = width(x)
    return bytes([w]) + x.astype(f"<i{w}").tobytes()


def unpack(raw: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions, int64 matrix) for each length of vector among the packed ones."""
    size = np.array([len(r) for r in raw], np.int64)
    lead = np.array([r[0] for r in raw], np.int64)
    dim = (size - 1) // np.maximum(lead, 1)
    out = []
    for d in np.unique(dim):
        own = np.flatnonzero(dim == d)
        x = np.empty((len(own), d), np.int64)
        for w in np.unique(lead[own]):
            at = np.flatnonzero(lead[own] == w)
            x[at] = np.frombuffer(b"".join(raw[own[i]][1:] for i in at), f"<i{w}").reshape(len(at), d)
        out.append((own, x))
    return out


def quantised(df: DataFrame, columns: dict[str, str], vector: str, scale: float) -> DataFrame:
    """The columns {name: SQL type} of df as they are, and x, the packed vector; a narrow stage."""

    def run(batches):
        for batch in batches:
            rows, at, x = entries(batch.column(len(columns)), scale)
            packed = pa.array([pack(x[at[i] : at[i + 1]]) for i in range(len(rows))], pa.binary())
            kept = [batch.column(i).take(pa.array(rows)) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*kept, packed], [*columns, "x"])

    picked = [F.col(c).cast(kind).alias(c) for c, kind in columns.items()]
    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in columns.items()), "x binary"])
    return df.select(*picked, F.col(vector).alias("_vector")).mapInArrow(run, schema)

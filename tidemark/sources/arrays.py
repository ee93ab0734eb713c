"""Recordings kept as .npy arrays: read by byte ranges in tasks, all arrays of a row together, and a registry of known recordings."""

from __future__ import annotations

import ast
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.raw import opened


@dataclass(frozen=True)
class Dataset:
    """A recording's rate (samples a second), contacts beside a spike's channel, samples of a waveform and length (s)."""

    name: str
    rate: float
    slots: int
    samples: int
    seconds: float


REGISTRY: dict[str, Dataset] = {}


def registered(dataset: Dataset) -> Dataset:
    if min(dataset.rate, dataset.slots, dataset.samples, dataset.seconds) <= 0:
        raise ValueError(f"{dataset.name}: rate, slots, samples and seconds are positive")
    REGISTRY[dataset.name] = dataset
    return dataset


for _d in (Dataset("derived", 30_000.0, 8, 8, 1958.0), Dataset("np1", 30_000.0, 10, 90, 1957.0), Dataset("ultra", 30_000.0, 10, 90, 60.0)):
    registered(_d)


def dataset(name: str) -> Dataset:
    if name not in REGISTRY:
        raise KeyError(f"unknown recording {name!r}: one of {sorted(REGISTRY)}")
    return REGISTRY[name]


@dataclass(frozen=True)
class Header:
    path: str
    dtype: str
    shape: tuple[int, ...]
    start: int

    @property
    def width(self) -> int:
        """Bytes of a row."""
        return int(np.dtype(self.dtype).itemsize * np.prod(self.shape[1:], dtype=np.int64))


def header(path: str) -> Header:
    """Of a .npy file: versions 1 to 3, row-major."""
    store, where = opened(path)
    with store.open_input_file(where) as f:
        magic = f.read(8)
        if magic[:6] != b"\x93NUMPY":
            raise ValueError(f"{path} isn't a .npy file")
        wide = magic[6] > 1
        size = struct.unpack("<I" if wide else "<H", f.read(4 if wide else 2))[0]
        d = ast.literal_eval(f.read(size).decode("utf-8" if magic[6] > 2 else "latin1"))
        if d["fortran_order"] and len(d["shape"]) > 1:
            raise ValueError(f"{path} is column-major")
        return Header(path, d["descr"], tuple(d["shape"]), f.tell())


def stretch(h: Header, lo: int, hi: int) -> np.ndarray:
    store, where = opened(h.path)
    with store.open_input_file(where) as f:
        f.seek(h.start + lo * h.width)
        return np.frombuffer(f.read((hi - lo) * h.width), h.dtype).reshape(hi - lo, -1)


def rows(spark: SparkSession, columns: dict[str, tuple[str, str]], block: int = 4096) -> DataFrame:
    """row and one column for each {name: (path, SQL type)}, from arrays of equally many rows; a type array<...> takes a whole row.

    Blocks of rows are dealt to tasks, each of which reads its own bytes of every array: no join, no shuffle.
    """
    heads = {name: header(path) for name, (path, _) in columns.items()}
    counts = {name: h.shape[0] for name, h in heads.items()}
    if len(set(counts.values())) > 1:
        raise ValueError(f"arrays of different lengths: {counts}")
    n = next(iter(counts.values()))
    flat = {name: kind for name, (_, kind) in columns.items() if not kind.startswith("array")}
    wrong = [name for name in flat if int(np.prod(heads[name].shape[1:], dtype=np.int64)) != 1]
    if wrong:
        raise ValueError(f"not one value a row: {wrong}")
    kinds = {name: spark.createDataFrame([], f"x {kind}").schema[0].dataType for name, (_, kind) in columns.items()}
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = {name: to_arrow_type(k) for name, k in kinds.items()}

    def run(batches):
        for batch in batches:
            for b in batch.column(0).to_pylist():
                lo, hi = b * block, min(n, (b + 1) * block)
                cols = [pa.array(np.arange(lo, hi))]
                for name, h in heads.items():
                    x = stretch(h, lo, hi)
                    if name in flat:
                        cols.append(pa.array(x[:, 0]).cast(arrow[name], safe=False))
                    else:
                        own = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                        cols.append(own.cast(arrow[name]))
                yield pa.RecordBatch.from_arrays(cols, ["row", *heads])

    schema = "row long, " + ", ".join(f"`{name}` {kind}" for name, (_, kind) in columns.items())
    return spark.range(-(-n // block)).mapInArrow(run, schema)


def recording(spark: SparkSession, folder: str, name: str = "np1") -> DataFrame:
    """spike_id, sample, t, channel, w of a folder with spike_times.npy, spike_channels.npy and waveforms.npy (spikes x slots x samples)."""
    d = dataset(name)
    h = header(f"{folder}/waveforms.npy")
    if h.shape[1:] != (d.slots, d.samples):
        raise ValueError(f"waveforms are {h.shape[1:]}, {name} has {(d.slots, d.samples)}")
    r = rows(spark, {"sample": (f"{folder}/spike_times.npy", "long"), "channel": (f"{folder}/spike_channels.npy", "int"), "w": (f"{folder}/waveforms.npy", "array<double>")})
    return r.selectExpr("row as spike_id", "sample", f"sample / {d.rate}D as t", "channel", "w")

"""Raw recordings: interleaved int16 samples of all channels, read in windows by a Spark data source.

A recording is a file or a folder of files that follow each other by name, each of whole samples. ``register(spark)`` makes
``spark.read.format("tidemark_raw")`` known. Each partition is a stretch of ``window`` samples; it reads its own byte ranges with
``pad`` samples of its neighbours on both sides, filters, and gives back only its own, so windows can be of any length and
nothing is shuffled. Paths are opened by pyarrow's file systems (local, HDFS, object stores).

The filter is a third-order Butterworth high pass, run forwards and backwards (no phase), then the median over channels comes off each
sample. The recursion starts from the window's first sample as if it had lasted for ever, and forgets its start long
before the pad ends, so any split gives the same samples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

DEFAULTS = {"channels": 385, "rate": 30_000.0, "window": 30_000, "pad": 300, "cutoff": 300.0, "scale": 1.0, "filter": "true", "reference": "true"}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the recording's files in order."""
    store, where = opened(path)
    info = store.get_file_info(where)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else [f for f in store.get_file_info(fs.FileSelector(where)) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
    return sorted((f.path, f.size) for f in found)


def high_pass(rate: float, cutoff: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sections (b, a), a[0] = 1, of the third-order Butterworth high pass, by the bilinear transform of its analogue form."""
    w = np.tan(np.pi * cutoff / rate)
    first = (np.array([1.0, -1.0]) / (1 + w), np.array([1.0, (w - 1) / (w + 1)]))
    # the pair of poles at 60 degrees from the real axis: s^2 + w s + w^2
    norm = 1 + w + w * w
    second = (np.array([1.0, -2.0, 1.0]) / norm, np.array([1.0, 2 * (w * w - 1) / norm, (1 - w + w * w) / norm]))
    return [first, second]


def run_section(x: np.ndarray, b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """y of the recursion over rows (samples x channels), as if the first row had been there for ever."""
    n = len(a) - 1
    y = np.empty_like(x)
    z = np.zeros((n, x.shape[1]))
    # steady state of a constant input
    level = b.sum() / a.sum()
    for i in range(n - 1, -1, -1):
        z[i] = (b[i + 1] - a[i + 1] * level) * x[0] + (z[i + 1] if i + 1 < n else 0)
    for t in range(len(x)):
        out = b[0] * x[t] + z[0]
        for i in range(n - 1):
            z[i] = b[i + 1] * x[t] - a[i + 1] * out + z[i + 1]
        z[n - 1] = b[n] * x[t] - a[n] * out
        y[t] = out
    return y


def zero_phase(x: np.ndarray, rate: float, cutoff: float) -> np.ndarray:
    for _ in range(2):
        for b, a in high_pass(rate, cutoff):
            x = run_section(x, b, a)
        x = x[::-1]
    return x


class Window(InputPartition):
    def __init__(self, start: int, stop: int) -> None:
        self.start, self.stop = start, stop


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        o = {**DEFAULTS, **{k.lower(): v for k, v in options.items()}}
        if "path" not in o:
            raise ValueError("option path is missing")
        self.path, self.channels, self.window, self.pad = o["path"], int(o["channels"]), int(o["window"]), int(o["pad"])
        self.rate, self.cutoff, self.scale = float(o["rate"]), float(o["cutoff"]), float(o["scale"])
        self.filter, self.reference = (str(o[k]).lower() == "true" for k in ("filter", "reference"))
        if self.channels < 1 or self.window < 1 or self.pad < 0 or not 0 < self.cutoff < self.rate / 2:
            raise ValueError("channels and window are positive, pad isn't negative, the cutoff lies below half the rate")
        self.files = files(self.path)
        ragged = [f for f, size in self.files if size % (2 * self.channels)]
        if ragged:
            raise ValueError(f"not whole samples of {self.channels} channels: {ragged[:3]}")

    @property
    def samples(self) -> int:
        return sum(size for _, size in self.files) // (2 * self.channels)

    def partitions(self) -> list[Window]:
        return [Window(s, min(s + self.window, self.samples)) for s in range(0, self.samples, self.window)] or [Window(0, 0)]

    def stretch(self, start: int, stop: int) -> np.ndarray:
        """Samples start..stop-1 as int16 (samples x channels), from the files that hold them."""
        width, at, parts = 2 * self.channels, 0, []
        store, _ = opened(self.path)
        for path, size in self.files:
            n = size // width
            lo, hi = max(start, at), min(stop, at + n)
            if lo < hi:
                with store.open_input_file(path) as f:
                    f.seek((lo - at) * width)
                    parts.append(np.frombuffer(f.read((hi - lo) * width), "<i2").reshape(-1, self.channels))
            at += n
        return np.concatenate(parts) if parts else np.empty((0, self.channels), "<i2")

    def read(self, partition: Window) -> Iterator[pa.RecordBatch]:
        lo, hi = max(0, partition.start - self.pad), min(self.samples, partition.stop + self.pad)
        x = self.stretch(lo, hi).astype(np.float64) * self.scale
        if not len(x):
            return
        if self.filter:
            x = zero_phase(x, self.rate, self.cutoff)
        if self.reference:
            x = x - np.median(x, axis=1, keepdims=True)
        x = x[partition.start - lo : partition.stop - lo]
        for s in range(0, len(x), 4096):
            part = np.ascontiguousarray(x[s : s + 4096], np.float32)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * self.channels, pa.int32()), pa.array(part.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(partition.start + s, partition.start + s + len(part))), rows], ["sample", "v"])


class Raw(DataSource):
    """Options: path, channels, rate (samples a second), window and pad (samples), cutoff (per second), scale, filter, reference."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_raw"

    def schema(self) -> str:
        return "sample long, v array<float>"

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Raw)


def written(points: DataFrame, path: str, channels: int, samples: int, chunk: int) -> DataFrame:
    """Writes points (sample, channel, value) as a recording of `samples` samples, zeros between them, one file for `chunk` samples; values at
    one place add up. start, samples, bytes of each file. Runs when an action does; a file that a lost task left half written is replaced."""
    spark = points.sparkSession
    every = spark.range(-(-samples // chunk)).select(F.col("id").alias("chunk"))
    ours = points.where((F.col("sample") >= 0) & (F.col("sample") < samples) & (F.col("channel") >= 0) & (F.col("channel") < channels))
    ours = ours.groupBy("sample", "channel").agg(F.sum("value").alias("value")).select(F.expr(f"sample div {chunk}").alias("chunk"), "sample", "channel", "value")

    def write(key, chunks, rows):
        c = key[0].as_py()
        n = min(chunk, samples - c * chunk)
        x = np.zeros((n, channels))
        x[rows["sample"].to_numpy() - c * chunk, rows["channel"].to_numpy()] = rows["value"].to_numpy()
        raw = np.clip(np.rint(x), -32768, 32767).astype("<i2").tobytes()
        store, where = opened(path)
        store.create_dir(where, recursive=True)
        name, part = f"{where.rstrip('/')}/chunk-{c:09d}.bin", f"{where.rstrip('/')}/.part-{c:09d}-{np.random.default_rng().integers(1 << 62)}"
        with store.open_output_stream(part) as f:
            f.write(raw)
        store.move(part, name)
        return pa.table({"start": pa.array([c * chunk]), "samples": pa.array([n], pa.int64()), "bytes": pa.array([len(raw)], pa.int64())})

    return every.groupBy("chunk").cogroup(ours.select("chunk", "sample", F.col("channel").cast("long").alias("channel"), F.col("value").cast("double").alias("value")).groupBy("chunk")).applyInArrow(write, "start long, samples long, bytes long")

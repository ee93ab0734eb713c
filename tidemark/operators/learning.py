"""Codebook learning: distributed sufficient statistics, tiny solves on the driver.

Each pass over the spikes is one job that returns sums: the residual and energy under the best place of every spike, and the
scatter of its footprint-weighted waveform. The driver solves an eigenproblem of the number of samples (8 here) and decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.inference import footprints
from tidemark.sources.recording import SAMPLES, SLOTS


def _places(spark, kernel: str) -> dict[int, np.ndarray]:
    """Unit footprints (slots x candidates) by channel: 64 small matrices."""
    return {r["channel"]: np.array([c["g"] for c in r["cand"]]).T for r in footprints(spark, kernel).select("channel", "cand").collect()}


def scatter(spikes: DataFrame) -> np.ndarray:
    """Sum over spikes and slots of outer products of DC-free rows: samples x samples."""

    def run(batches):
        for batch in batches:
            y = batch.column(0).flatten().to_numpy().reshape(-1, SLOTS, SAMPLES)
            y = y - y.mean(2, keepdims=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.einsum("bct,bcu->tu", y, y).ravel()[None].tolist(), pa.list_(pa.float64()))], ["s"])

    part = spikes.select("w").mapInArrow(run, "s array<double>")
    sums = part.agg(*[F.sum(F.element_at("s", i + 1)) for i in range(SAMPLES * SAMPLES)]).first()
    return np.array([x or 0.0 for x in sums]).reshape(SAMPLES, SAMPLES)


def scatters(spikes: DataFrame, by: str) -> DataFrame:
    """by, i, j, v: the scatter of each group. A task adds its batches' products up by group, so a shuffle carries one matrix a task and group."""
    kind = spikes.schema[by].dataType.simpleString()

    def run(batches):
        total: dict = {}
        for batch in batches:
            key = batch.column(0).dictionary_encode()
            of = key.indices.fill_null(len(key.dictionary)).to_numpy(zero_copy_only=False)
            names = [*key.dictionary.to_pylist(), None]
            y = batch.column(1).flatten().to_numpy().reshape(-1, SLOTS, SAMPLES)
            y = y - y.mean(2, keepdims=True)
            for g in np.unique(of):
                own = y[of == g].reshape(-1, SAMPLES)
                total[names[g]] = total.get(names[g], 0) + own.T @ own
        i, j = (v.ravel() for v in np.indices((SAMPLES, SAMPLES)))
        for name, s in total.items():
            cols = [pa.array([name] * s.size, batch.schema.field(0).type), pa.array(i.astype(np.int64)), pa.array(j.astype(np.int64)), pa.array(s.ravel())]
            yield pa.RecordBatch.from_arrays(cols, [by, "i", "j", "v"])

    return spikes.select(by, "w").mapInArrow(run, f"`{by}` {kind}, i long, j long, v double").groupBy(by, "i", "j").agg(F.sum("v").alias("v"))


def leading(matrix: np.ndarray, m: int) -> np.ndarray:
    """The m leading eigenvectors as rows, each with its largest component positive."""
    rows = np.linalg.eigh(matrix)[1][:, ::-1][:, :m].T
    return rows * np.sign(rows[np.arange(m), np.abs(rows).argmax(1)])[:, None]


def evaluated(spikes: DataFrame, omega: np.ndarray, shapes: dict[int, np.ndarray]) -> tuple[float, float, np.ndarray]:
    """Residual, energy and scatter at the best place of every spike, in one job."""

    def run(batches):
        for batch in batches:
            channel = batch.column(0).to_numpy()
            y = batch.column(1).flatten().to_numpy().reshape(-1, SLOTS, SAMPLES)
            y = y - y.mean(2, keepdims=True)
            sse = energy = 0.0
            s = np.zeros((SAMPLES, SAMPLES))
            for c in np.unique(channel):
                own = y[channel == c]
                u = np.einsum("cn,bct->bnt", shapes[int(c)], own, optimize=True)
                score = ((u @ omega.T) ** 2).sum(2)
                best = score.argmax(1)
                v = u[np.arange(len(own)), best]
                s += v.T @ v
                energy += (own**2).sum()
                sse += (own**2).sum() - score.max(1).sum()
            yield pa.RecordBatch.from_arrays([pa.array([[sse, energy, *s.ravel()]], pa.list_(pa.float64()))], ["s"])

    part = spikes.select("channel", "w").mapInArrow(run, "s array<double>")
    sums = part.agg(*[F.sum(F.element_at("s", i + 1)) for i in range(2 + SAMPLES * SAMPLES)]).first()
    v = np.array([x or 0.0 for x in sums])
    return float(v[0]), float(v[1]), v[2:].reshape(SAMPLES, SAMPLES)


def fit(spikes: DataFrame, m: int = 3, outer: int = 6, kernel: str = "monopole") -> tuple[np.ndarray, list[dict]]:
    """Orthonormal codebook by alternation: place every spike, take the leading directions there, keep them if the error falls.

    A proposal that raises the error is blended half and a quarter with the codebook before; if that doesn't help, the fit ends.
    The pool is persisted once; every trial is one job over it.
    """
    shapes = _places(spikes.sparkSession, kernel)
    pool = spikes.select("channel", "w").persist()
    try:
        omega = leading(scatter(pool), m)
        sse, energy, s = evaluated(pool, omega, shapes)
        history = [{"iteration": 0, "alpha": 1.0, "nmse": sse / max(energy, 1e-300)}]
        for i in range(1, outer + 1):
            target, now = leading(s, m), history[-1]["nmse"]
            for alpha in (1.0, 0.5, 0.25):
                u, _, v = np.linalg.svd((1 - alpha) * omega + alpha * target, full_matrices=False)
                trial = target if alpha == 1 else u @ v
                sse, energy, after = evaluated(pool, trial, shapes)
                if sse / max(energy, 1e-300) <= now:
                    omega, s = trial, after
                    history.append({"iteration": i, "alpha": alpha, "nmse": sse / max(energy, 1e-300)})
                    break
            else:
                break
            if now - history[-1]["nmse"] < 1e-5:
                break
        return omega, history
    finally:
        pool.unpersist()


def block_pca(rows: DataFrame, by: str, vector: str, ident: str, k: int = 3, least: int = 20) -> DataFrame:
    """ident, by, k scores of unit-length vectors in the principal axes of their block, scaled to rank / (n - 1).

    The covariance of a block is a sum (aggregated before the shuffle); only it, samples squared in size, meets the rows again.
    """
    norm = F.greatest(F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-12))
    d = rows.select(ident, by, F.transform(vector, lambda x: x / norm).alias("v"))
    dim = SAMPLES
    sums = [F.sum(F.element_at("v", i + 1)).alias(f"m{i}") for i in range(dim)] + [F.sum(F.element_at("v", i + 1) * F.element_at("v", j + 1)).alias(f"c{i}_{j}") for i in range(dim) for j in range(i, dim)]
    stats = d.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *sums).where(F.col("n") >= least)

    def axes(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                mean = np.array([r[f"m{i}"] for i in range(dim)]) / r["n"]
                cov = np.zeros((dim, dim))
                for i in range(dim):
                    for j in range(i, dim):
                        cov[i, j] = cov[j, i] = r[f"c{i}_{j}"] / r["n"] - mean[i] * mean[j]
                out.append((r[by], mean.tolist(), leading(cov, k).ravel().tolist()))
            cols = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(by).type), pa.array(cols[1], pa.list_(pa.float64())), pa.array(cols[2], pa.list_(pa.float64()))], [by, "mean", "axes"])

    kind = rows.schema[by].dataType.simpleString()
    a = stats.mapInArrow(axes, f"{by} {kind}, mean array<double>, axes array<double>")
    j = d.join(a, by)
    centred = F.zip_with("v", "mean", lambda x, m: x - m)
    score = [F.aggregate(F.zip_with(centred, F.slice("axes", i * dim + 1, dim), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x).alias(f"pc{i}") for i in range(k)]
    return j.select(ident, by, *score)

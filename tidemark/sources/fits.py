"""Whole fits as folders: assignments, codebook, summary and history; saved once, checked, and read back with everything needed to go on.

A folder holds ``assignments`` (Parquet: spike_id, channel, k, amp, coef, px, py, pz), ``codebook.json`` (sites, profiles or widths,
shapes, prototypes), ``history.jsonl`` and, written last, ``summary.json`` with a fingerprint of the codebook. A fit without a summary isn't
complete and is written again; a complete one is kept as it is.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import packed
from tidemark.operators.candidates import Candidates
from tidemark.operators.inference import centred
from tidemark.operators.refine import Learned
from tidemark.sources.recording import channels, geometry

CHECKS = {
    "spike_id is there": "spike_id is not null",
    "candidate in the codebook": "k >= 0 and k < {K}",
    "amplitude": "amp >= 0 and not isnan(amp)",
    "finite place": "not isnan(px) and not isnan(py) and not isnan(pz)",
}


def fingerprint(*parts: np.ndarray) -> str:
    """SHA-256 of shapes and values, little-endian doubles."""
    h = hashlib.sha256()
    for p in parts:
        a = np.ascontiguousarray(p, "<f8")
        h.update(str(a.shape).encode())
        h.update(a.tobytes())
    return h.hexdigest()


@dataclass
class Fit:
    candidates: Candidates | Learned
    omega: np.ndarray
    assignments: DataFrame | None = None
    summary: dict | None = None

    @property
    def sites(self) -> int:
        return len(self.candidates.sites)

    def described(self) -> dict:
        """The codebook as plain values."""
        c = self.candidates
        own = {"widths": c.widths.tolist(), "kernel": c.kernel, "b": c.b} if isinstance(c, Learned) else {"profiles": [list(p) for p in c.profiles]}
        return {"sites": np.asarray(c.sites).tolist(), "omega": np.asarray(self.omega).tolist(), "fingerprint": fingerprint(c.sites, self.omega), **own}

    def footprints(self, spark: SparkSession) -> dict[int, np.ndarray]:
        """Unit footprints (slots x candidates) of the fit's own codebook by channel."""
        rows = geometry(spark).select("channel", "dx", "dy").collect()
        return {r["channel"]: self.candidates.footprints(np.array(r["dx"]), np.array(r["dy"])).T for r in rows}


def assigned(spikes: DataFrame, fit: Fit) -> DataFrame:
    """spike_id, t, channel, k, amp, coef, px, py, pz (um, absolute) of every spike under a fit: two narrow stages and the probe's 64 rows."""
    spark, omega, candidates = spikes.sparkSession, np.asarray(fit.omega), fit.candidates
    offsets = {r["channel"]: (np.array(r["dx"]), np.array(r["dy"])) for r in geometry(spark).select("channel", "dx", "dy").collect()}
    anchor = {r["channel"]: (r["x"], r["y"]) for r in channels(spark).collect()}
    turn, p = packed.whitener(omega), len(candidates.profiles)
    schema = "spike_id long, t double, channel int, k long, amp double, coef array<double>, px double, py double, pz double, sse double"

    def run(batches):
        for batch in batches:
            channel, y = batch.column(2).to_numpy(), centred(batch.column(3))
            k, coef, got = np.zeros(len(y), np.int64), np.zeros((len(y), len(omega))), np.zeros(len(y))
            for c in np.unique(channel):
                own = np.flatnonzero(channel == c)
                k[own], _ = packed.best(packed.pack_forms(y[own], turn), candidates, *offsets[c])
                g = candidates.footprints(*offsets[c])[k[own]]
                coef[own], got[own] = packed.hard_coefficients(y[own], g, omega)
            place = np.asarray(candidates.sites)[k // p] + np.array([[*anchor[c], 0.0] for c in channel.tolist()]).reshape(-1, 3)
            amp = np.linalg.norm(coef @ omega, axis=1)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * len(omega), pa.int32()), pa.array(coef.ravel()))
            cols = [*batch.columns[:3], pa.array(k), pa.array(amp), flat, *(pa.array(v) for v in place.T), pa.array(np.einsum("bct,bct->b", y, y) - got)]
            yield pa.RecordBatch.from_arrays(cols, [s.split()[0] for s in schema.split(", ")])

    return spikes.select("spike_id", "t", "channel", "w").mapInArrow(run, schema)


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _put(spark: SparkSession, path: str, text: str) -> None:
    p, store = _hadoop(spark, path)
    stream = store.create(p, True)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()


def _get(spark: SparkSession, path: str) -> str | None:
    p, store = _hadoop(spark, path)
    if not store.exists(p):
        return None
    stream = store.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def complete(spark: SparkSession, path: str) -> bool:
    return _get(spark, f"{path}/summary.json") is not None


def save(spark: SparkSession, path: str, fit: Fit, config: dict, history: list[dict] = ()) -> bool:
    """Writes the fit unless a complete one is there (False). A check that fails is a ValueError that counts what is broken."""
    if complete(spark, path):
        return False
    a = fit.assignments
    rules = {name: rule.format(K=len(fit.candidates)) for name, rule in CHECKS.items()}
    found = a.agg(*[F.count_if(~F.coalesce(F.expr(r), F.lit(False))).alias(n) for n, r in rules.items()], F.count(F.lit(1)).alias("spikes"), F.countDistinct("k").alias("cands_used"), F.countDistinct(F.expr(f"k div {len(fit.candidates.profiles)}")).alias("sites_used"), F.sum("sse").alias("sse")).first()
    broken = {n: found[n] for n in rules if found[n]}
    if broken:
        raise ValueError(f"assignments: {broken}")
    a.write.mode("overwrite").parquet(f"{path}/assignments")
    _put(spark, f"{path}/codebook.json", json.dumps(fit.described()))
    _put(spark, f"{path}/history.jsonl", "".join(json.dumps(h) + "\n" for h in history))
    summary = {"config": config, "K": fit.sites, "KS": len(fit.candidates), "Q": len(fit.omega), "learned": isinstance(fit.candidates, Learned), "fingerprint": fit.described()["fingerprint"]}
    summary |= {c: found[c] for c in ("spikes", "cands_used", "sites_used", "sse")}
    _put(spark, f"{path}/summary.json", json.dumps(summary))
    return True


def load(spark: SparkSession, path: str) -> Fit:
    """A complete fit, of either family; an incomplete one, a missing part or a codebook that doesn't match its fingerprint is an error."""
    parts = {n: _get(spark, f"{path}/{n}.json") for n in ("summary", "codebook")}
    lacking = [n for n, text in parts.items() if text is None]
    if lacking:
        raise FileNotFoundError(f"{path} lacks {lacking}")
    b, summary = json.loads(parts["codebook"]), json.loads(parts["summary"])
    sites, omega = np.array(b["sites"]).reshape(-1, 3), np.array(b["omega"])
    if fingerprint(sites, omega) != summary["fingerprint"]:
        raise ValueError(f"{path}: the codebook isn't the one that the summary describes")
    c = Learned(sites, np.array(b["widths"]), b["kernel"], b["b"]) if summary["learned"] else Candidates(sites, [(n, a, x) for n, a, x in b["profiles"]])
    return Fit(c, omega, spark.read.parquet(f"{path}/assignments"), summary)


def rescaled(assignments: DataFrame, to: float = 100.0, column: str = "amp") -> DataFrame:
    """Amplitudes with a median of `to`; a median that isn't positive is an error, since no factor brings it there."""
    median = assignments.agg(F.percentile_approx(column, 0.5, 100_000).alias("m")).first()["m"]
    if median is None or not median > 0:
        raise ValueError(f"amplitude median is {median}: nothing to rescale")
    return assignments.withColumn(column, F.col(column) * (to / median))


def placed(assignments: DataFrame, fit: Fit) -> DataFrame:
    """x, y, z relative to the spike's contact: explicit columns px, py, pz win where they are there and not null, else the candidate's site."""
    spark, p = assignments.sparkSession, len(fit.candidates.profiles)
    sites = spark.createDataFrame([(i, *map(float, s)) for i, s in enumerate(fit.candidates.sites)], "_site long, _x double, _y double, _z double")
    j = assignments.withColumn("_site", F.expr(f"k div {p}")).join(sites, "_site", "left").join(F.broadcast(channels(spark).select("channel", F.col("x").alias("_cx"), F.col("y").alias("_cy"))), "channel", "left")

    def pick(own: str, site: str, base: Column) -> Column:
        return F.coalesce(F.col(own) - base, F.col(site)) if own in assignments.columns else F.col(site)

    return j.select(*assignments.columns, pick("px", "_x", F.col("_cx")).alias("x"), pick("py", "_y", F.col("_cy")).alias("y"), pick("pz", "_z", F.lit(0.0)).alias("z"))

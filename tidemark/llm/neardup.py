"""Embedding near-duplicates by sorted projection passes.

Each pass gives every vector a key of ``BITS`` concatenated random-hyperplane hashes, sorts all vectors by it (range
partitioning; ties by a hash of the id, so a hot key spreads over tasks) and compares each with the ``WINDOW`` vectors after it,
across batches and partitions: tasks hand on the ends of their partitions, which are compared in groups by boundary. Pairs of
cosine >= threshold are verified in double precision on the original vectors and union over the passes into components. The
number of passes follows the number of vectors (``passes_for``), so that a pair right at the threshold is met in some window
with probability ``RECALL`` where keys spread as those of random directions. Windows bound what a pass compares, so dense
groups are completed exactly: inside every component found, all vectors are compared in blocks by matrix products, and each
vector's links are counted - pairs are never emitted.

Null vectors, zero vectors, vectors with null or non-finite components, of another length than most, and rows with a null id
link with nothing. Repeated ids are one vector (the smallest by array order). Every non-null id gets one row; rows with a null id
share one row with no component.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import components, parted, tune, written

THRESHOLD, PASSES, BITS, WINDOW, SEED = 0.9, 14, 48, 512, 20
#: Least share of pairs right at the threshold that the passes meet; PASSES is the least number of passes.
RECALL = 0.999
BLOCK = 1024


def passes_for(n: int, threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes that meet a pair of this cosine with probability `recall` among n vectors.

    Such a pair agrees in a bit with p = 1 - acos(threshold) / pi, and a window holds all that share log2(n / window) leading bits.
    """
    agree = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    met = agree ** max(0.0, math.log2(max(n, 1) / window))
    return PASSES if met >= 1 else max(PASSES, math.ceil(math.log(1 - recall) / math.log1p(-met)))


def clean(df: DataFrame, ident: str, vector: str) -> DataFrame:
    """id, v: usable vectors as array<double>, one row an id."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    d = df.select(F.col(ident).cast("long").alias("id"), v.alias("v")).where("id is not null")
    d = d.groupBy("id").agg(F.min("v").alias("v"))
    return d.where(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array<double> column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither squares nor sums overflow
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def by_length(ids: np.ndarray, column: pa.Array):
    """(ids, unit rows) for each length of vector in a batch."""
    lengths = np.diff(column.offsets.to_numpy())
    for n in np.unique(lengths):
        pick = np.flatnonzero(lengths == n)
        yield ids[pick], unit(matrix(column.take(pa.array(pick))))


def _keys(passes: int, bits: int, seed: int):
    def run(batches):
        planes = {}
        for batch in batches:
            for ids, x in by_length(batch.column(0).to_numpy(), batch.column(1)):
                d = x.shape[1]
                if d not in planes:
                    planes = {d: np.random.default_rng([seed, d]).normal(size=(d, passes * bits))}
                side = (x @ planes[d] > 0).reshape(len(x), passes, bits)
                key = (side * (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))).sum(2)
                x = np.ascontiguousarray(x)
                raw = pa.array([r.tobytes() for r in x], pa.binary())
                for p in range(passes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), p), pa.int32()), pa.array(key[:, p]), pa.array(ids), raw], ["pass", "key", "id", "x"])

    return run


_FOUND = "a long, b long, part int, head boolean, pos long, pass int, id long, x binary"


def _pairs(x: np.ndarray, p: np.ndarray, ids: np.ndarray, pos: np.ndarray, y: np.ndarray, q: np.ndarray, more: np.ndarray, at: np.ndarray, threshold: float, window: int):
    """Links between rows x and later rows y of one length: same pass, at most `window` apart, another id."""
    i, j = np.nonzero(x @ y.T >= threshold)
    ok = (p[i] == q[j]) & (ids[i] != more[j]) & (at[j] > pos[i]) & (at[j] - pos[i] <= window)
    return ids[i[ok]], more[j[ok]]


def _stacked(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), dtype=np.float64).reshape(len(raw), -1)


def _window(threshold: float, window: int):
    """Links among rows at most `window` apart in the order of a partition, as a forest; its first and last rows as they are."""
    from tidemark.llm.shared import forest

    names = [c.split()[0] for c in _FOUND.split(", ")]

    def links(a, b):
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *(pa.nulls(n, t) for t in (pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names)

    def ends(head, pos, p, ids, raw):
        n, part = len(raw), TaskContext.get().partitionId()
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([part] * n, pa.int32()), pa.array([head] * n, pa.bool_()), pa.array(pos, pa.int64()), pa.array(p, pa.int32()), pa.array(ids, pa.int64()), pa.array(raw, pa.binary())], names)

    def run(batches):
        done, tails = 0, {}
        last_p, last_id, last_x = np.empty(0, np.int32), np.empty(0, np.int64), []
        for batch in batches:
            p, ids, raw = batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_pylist()
            pos = np.arange(done, done + len(raw))
            if done < window:
                k = window - done
                yield ends(True, pos[:k], p[:k], ids[:k], raw[:k])
            lengths = np.array([len(r) for r in raw])
            for n in np.unique(lengths):
                for s in range(0, len(raw), 1024):
                    own = np.flatnonzero(lengths[s : s + 1024] == n) + s
                    if not len(own):
                        continue
                    new = (_stacked([raw[i] for i in own]), p[own], ids[own], pos[own])
                    if n in tails:
                        both = [np.concatenate(v) for v in zip(tails[n], new, strict=True)]
                    else:
                        both = list(new)
                    a, b = _pairs(*both, *new, threshold, window)
                    if len(a):
                        yield links(*forest(a, b))
                    tails[n] = [v[-window:] for v in both]
            done += len(raw)
            last_p, last_id, last_x = np.concatenate([last_p, p])[-window:], np.concatenate([last_id, ids])[-window:], (last_x + raw)[-window:]
        if done:
            yield ends(False, np.arange(done - len(last_x), done), last_p, last_id, last_x)

    return run


def _across(threshold: float, window: int):
    """Links from the last rows of one partition to the first rows of those after it, as a forest."""
    from tidemark.llm.shared import forest

    def run(table):
        head, p, ids, pos = (table[c].to_numpy() for c in ("head", "pass", "id", "pos"))
        raw = table["x"].to_pylist()
        lengths = np.array([len(r) for r in raw])
        found_a, found_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for n in np.unique(lengths):
            left, right = np.flatnonzero((lengths == n) & ~head), np.flatnonzero((lengths == n) & head)
            if len(left) and len(right):
                sides = [(_stacked([raw[i] for i in o]), p[o], ids[o], pos[o]) for o in (left, right)]
                a, b = _pairs(*sides[0], *sides[1], threshold, window)
                found_a.append(a)
                found_b.append(b)
        a, b = forest(np.concatenate(found_a), np.concatenate(found_b))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def windowed(ranged: DataFrame, threshold: float, window: int) -> DataFrame:
    """a, b: links among rows at most `window` apart in the order of all partitions together."""
    spark = ranged.sparkSession
    found = written(ranged.mapInArrow(_window(threshold, window), _FOUND), "windows")
    # two numbers a partition: where its rows start in the whole order
    size = {r["part"]: r["n"] for r in found.where("not head").groupBy("part").agg((F.max("pos") + 1).alias("n")).collect()}
    parts, start, total = sorted(size), {}, 0
    for k in parts:
        start[k] = total
        total += size[k]
    meets = []
    for i, t in enumerate(parts):
        for k in parts[i + 1 :]:
            if start[k] - (start[t] + size[t]) >= window:
                break
            meets.append((k, True, t, start[k]))
        meets.append((t, False, t, start[t]))
    meets = spark.createDataFrame(meets, "part int, head boolean, boundary int, first long")
    ends = found.where("head is not null").join(F.broadcast(meets), ["part", "head"])
    ends = ends.select("boundary", "head", "pass", "id", "x", (F.col("pos") + F.col("first")).alias("pos"))
    return found.where("head is null").select("a", "b").union(ends.groupBy("boundary").applyInArrow(_across(threshold, window), "a long, b long"))


def _count(threshold: float):
    """Of one pair of blocks of one component: id, links of it to the other block."""

    def run(key, table):
        i, j = key[1].as_py(), key[2].as_py()
        ids, block, column = table["id"].to_numpy(), table["block"].to_numpy(), table["v"].combine_chunks()
        out_id, out_n = [], []
        for own, x in by_length(np.arange(len(ids)), column):
            b = block[own]
            left, right = np.flatnonzero(b == i), np.flatnonzero(b == j)
            n_left, n_right = np.zeros(len(left), dtype=np.int64), np.zeros(len(right), dtype=np.int64)
            for s in range(0, len(left), 1024):
                hit = x[left[s : s + 1024]] @ x[right].T >= threshold
                if i == j:
                    hit[np.arange(len(hit)), np.arange(s, s + len(hit))] = False
                n_left[s : s + 1024] += hit.sum(1)
                n_right += hit.sum(0)
            out_id.append(ids[own[left]])
            out_n.append(n_left)
            if i != j:
                out_id.append(ids[own[right]])
                out_n.append(n_right)
        return pa.table({"id": np.concatenate(out_id), "n": np.concatenate(out_n)})

    return run


def near_duplicates(df: DataFrame, ident: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, passes: int | None = None, bits: int = BITS, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """One row an id: its links, component (smallest linked id, its own without links) and whether it is kept."""
    spark = df.sparkSession
    tune(spark)
    vectors = written(clean(df, ident, vector), "vectors")
    passes = passes or passes_for(vectors.count(), threshold, window)
    keyed = vectors.mapInArrow(_keys(passes, bits, seed), "pass int, key long, id long, x binary")
    # materialised, so that the sampling of the range partitioning doesn't compute the keys twice
    keyed = written(keyed, "keys")
    order = ["pass", "key", F.xxhash64("id", "pass"), "id"]
    n = max(parted(spark), 1)
    ranged = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order)
    comp = written(components(windowed(ranged, threshold, window)), "components")
    sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("m"))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    member = comp.join(sizes, "component").select("node", "component", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"))
    # every member goes to each pair of blocks that holds its own; small components are packed by hash
    pair = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    member = member.select("node", "component", "block", pair.alias("other"))
    member = member.select("node", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    rows = member.join(vectors, member.node == vectors.id).select("component", "i", "j", "block", "id", "v")
    counted = rows.groupBy("component", "i", "j").applyInArrow(_count(threshold), "id long, n long").groupBy("id").agg(F.sum("n").alias("n_links"))
    ids = df.select(F.col(ident).cast("long").alias(ident)).distinct()
    out = ids.join(comp, ids[ident] == comp.node, "left").join(counted, ids[ident] == counted.id, "left")
    c = F.coalesce("component", F.col(ident))
    return out.select(ident, F.coalesce("n_links", F.lit(0)).alias("n_links"), c.alias("component_id"), F.coalesce(F.col(ident) == c, F.lit(False)).alias("kept"))

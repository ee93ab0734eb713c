"""Approximate nearest neighbours by randomly rotated one-bit codes.

All unit vectors are centred on one mean, rotated by one random orthogonal matrix and reduced to the signs of their coordinates,
packed into bytes, with two correction scalars: the residual's length and the inner product of its direction with its code.
For a rotated query the inner product with a code, divided by that scalar, is an unbiased estimate of the true inner product,
with a known error bound of about ``EPSILON`` standard deviations. Queries meet all vectors in blocks; in each block a running
k-th best verified score decides which vectors' upper bounds still matter, and only those are reranked in double precision on
the original vectors. Blocks hand on k rows a query, merged by a top-k per query.

The mean and the rotation come from at most ``SAMPLE`` vectors; every vector is coded, and no row is capped or dropped.
Nulls, zero vectors, null or non-finite components and null ids take no part; repeated ids are one vector. Vectors of another
length than the query's aren't its candidates. Ties go to the smaller id. Fewer than k candidates give fewer rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.neardup import by_length, clean
from tidemark.llm.shared import parted, tune, written

K, EPSILON, SAMPLE, SEED = 5, 3.0, 2000, 29
BLOCK, QUERIES = 8192, 256
_CODE = "cell long, n int, dim int, ids array<long>, codes binary, length binary, dot binary, vectors binary"


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, mean: np.ndarray, turn: np.ndarray):
    """Packed signs, residual lengths, and inner products of residual directions with their codes."""
    r = (x - mean) @ turn
    length = np.sqrt(np.einsum("ij,ij->i", r, r))
    side = r > 0
    dot = np.abs(r).sum(1) / np.sqrt(x.shape[1]) / np.where(length > 0, length, 1)
    return np.packbits(side, axis=1), length, np.where(length > 0, dot, 1.0)


def _pack(means: dict, block: int):
    def run(batches):
        held: dict[int, list] = {}

        def flush(dim):
            ids = np.concatenate([a for a, _ in held[dim]])
            x = np.concatenate([b for _, b in held[dim]])
            held[dim] = []
            codes, length, dot = encode(x, means.get(dim, np.zeros(dim)), rotation(dim))
            row = [int(ids[0]), len(ids), dim, ids, codes.tobytes(), length.tobytes(), dot.tobytes(), x.tobytes()]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["cell", "n", "dim", "ids", "codes", "length", "dot", "vectors"])

        for batch in batches:
            for ids, x in by_length(batch.column(0).to_numpy(), batch.column(1)):
                mine = held.setdefault(x.shape[1], [])
                mine.append((ids, x))
                if sum(len(a) for a, _ in mine) >= block:
                    yield flush(x.shape[1])
        for dim in [d for d, v in held.items() if v]:
            yield flush(dim)

    return run


def search_block(query: np.ndarray, query_ids: np.ndarray, ids, codes, length, dot, x, mean, k: int, epsilon: float):
    """(query row, id, score) of each query's k best of one block, by bounds and reranking."""
    dim = x.shape[1]
    turn = rotation(dim)
    bits = np.unpackbits(codes, axis=1, count=dim).astype(np.float32)
    signs = (2 * bits - 1) / np.sqrt(dim)
    base = x @ mean
    turned = (query - mean) @ turn
    # <q,x> = <q-m, x-m> + <q,m> + <x,m> - <m,m>
    rest = base[None] + (query @ mean)[:, None] - mean @ mean
    estimate = (turned.astype(np.float32) @ signs.T) * (length / dot)[None] + rest
    reach = np.sqrt(np.einsum("ij,ij->i", turned, turned))
    error = epsilon * reach[:, None] * (length * np.sqrt(np.maximum(1 - dot**2, 0)) / dot)[None] / np.sqrt(max(dim - 1, 1)) + 1e-6
    own = query_ids[:, None] == ids[None]
    estimate[own] = -np.inf
    upper = estimate + error
    out = []
    m = min(k, len(ids))
    for i in range(len(query)):
        first = np.argpartition(-estimate[i], m - 1)[:m]
        score = x[first] @ query[i]
        score[own[i][first]] = -np.inf
        bar = np.sort(score)[0]
        pick = np.flatnonzero(upper[i] >= bar)
        pick = pick[~own[i][pick]]
        s = np.einsum("ij,j->i", x[pick], query[i])
        o = np.lexsort((ids[pick], -s))[:k]
        out.append((np.full(len(o), i), ids[pick[o]], s[o]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _search(means: dict, k: int, epsilon: float):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                dim = r["dim"]
                query = np.frombuffer(r["q_vectors"]).reshape(-1, dim)
                x = np.frombuffer(r["vectors"]).reshape(-1, dim)
                codes = np.frombuffer(r["codes"], np.uint8).reshape(len(x), -1)
                q_ids = np.array(r["q_ids"])
                i, found, score = search_block(query, q_ids, np.array(r["ids"]), codes, np.frombuffer(r["length"]), np.frombuffer(r["dot"]), x, means.get(dim, np.zeros(dim)), k, epsilon)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(found), pa.array(score)], ["query_id", "vec_id", "score"])

    return run


def _queries(size: int):
    def run(batches):
        for batch in batches:
            for ids, x in by_length(batch.column(0).to_numpy(), batch.column(1)):
                for s in range(0, len(ids), size):
                    yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]], pa.int32()), pa.array([ids[s : s + size]], pa.list_(pa.int64())), pa.array([np.ascontiguousarray(x[s : s + size]).tobytes()], pa.binary())], ["dim", "q_ids", "q_vectors"])

    return run


def nearest(df: DataFrame, chosen: str, ident: str = "vec_id", vector: str = "embedding", k: int = K, epsilon: float = EPSILON, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest of each row that the SQL condition `chosen` (over id) picks."""
    spark = df.sparkSession
    tune(spark)
    vectors = written(clean(df, ident, vector), "vectors")
    some = vectors.orderBy(F.xxhash64("id")).limit(sample).collect()
    means: dict[int, np.ndarray] = {}
    for dim in {len(r["v"]) for r in some}:
        x = np.array([r["v"] for r in some if len(r["v"]) == dim])
        x = x / np.abs(x).max(axis=1, keepdims=True)
        means[dim] = (x / np.linalg.norm(x, axis=1, keepdims=True)).mean(0)
    cells = max(1, parted(spark))
    stored = written(vectors.repartition(cells, "id").mapInArrow(_pack(means, BLOCK), _CODE), "codes")
    asked = vectors.where(chosen).repartition(cells, "id").mapInArrow(_queries(QUERIES), "dim int, q_ids array<long>, q_vectors binary")
    # each block of queries goes to every block of vectors of its length by an equality on (dim, place): places are few and small
    asked = written(asked, "queries")
    n = stored.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    numbered = stored.select("cell", "dim").withColumn("place", F.row_number().over(Window.partitionBy("dim").orderBy("cell")) - 1)
    most = numbered.groupBy("dim").agg(F.count(F.lit(1)).alias("places"))
    asked = asked.join(most, "dim").withColumn("place", F.explode(F.expr("sequence(0, cast(places as int) - 1)"))).drop("places")
    met = asked.join(numbered, ["dim", "place"]).join(stored.drop("dim"), "cell").drop("place", "cell", "n")
    found = met.mapInArrow(_search(means, k, epsilon), "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

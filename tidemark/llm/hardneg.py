"""Hard-negative mining on STR-packed R-trees, exact.

Components become whole numbers (floor(scale * c)); scores are inner products of these. Vectors are sorted by length, label and the
coordinate of largest variance over the whole table (range partitions), and each task packs its run into trees: inside a label,
sort-tile-recursive slabs over the coordinates by falling variance, leaves of ``LEAF`` vectors with their least bounding boxes, ``FANOUT``
boxes to a node above. For an anchor q a box [lo, hi] gives for each coordinate the interval between q*lo and q*hi, and their sums bound
every inner product in it. A best-first queue takes the box with the highest score that could still count; boxes outside all score
windows, boxes of labels that don't count and boxes strictly below the k-th best so far are never opened (equal ones are: ids break ties).

Two searches: an anchor's ``positives`` nearest of its own label, then for each of those the ``negatives`` best of other labels
whose score lies in [low, high] hundredths of the positive's. Trees are rows, anchors come in blocks; each tree meets all anchors, at most
``ANCHORS`` in one group, so a group is bounded by a tree and that many anchors. Each group hands on k rows an anchor and window,
merged by rank.

Rows with a null id, null label, null or empty vector, or a null or non-finite component take no part. Repeated ids are one row (of the
smallest label, then packed vector). Vectors of another length than the anchor's aren't its candidates. Ties go to the smaller id. Fewer
candidates give fewer rows; a positive whose window is empty (as for negative scores) gives none; an empty table gives none.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import dropped, parted, tune, written
from tidemark.llm.vectors import quantised, unpack, width

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 10, 30, 90, 256.0
LEAF, FANOUT, BLOCK, ANCHORS = 256, 16, 1024, 1 << 18
#: Least and most vectors of a tree; between them, as many as give every task two trees.
TREE_LEAST, TREE_MOST = 4096, 1 << 17
_TREE = "cell long, dim int, ids binary, labels binary, x binary, wide int, lo binary, hi binary"


def str_order(x: np.ndarray, axes: np.ndarray, leaf: int) -> np.ndarray:
    """Rows in sort-tile-recursive order: slabs along the first axis, those again along the next, until a slab is a leaf."""
    leaves = -(-len(x) // leaf)
    if leaves <= 1 or not len(axes):
        return np.arange(len(x))
    slabs = max(2, int(np.ceil(leaves ** (1 / min(len(axes), max(1, int(np.ceil(np.log2(leaves)))))) - 1e-9)))
    order, size = np.argsort(x[:, axes[0]], kind="stable"), leaf * -(-leaves // slabs)
    return np.concatenate([order[s : s + size][str_order(x[order[s : s + size]], axes[1:], leaf)] for s in range(0, len(x), size)])


class Tree:
    """Vectors in leaf order, and boxes of all levels (labels are the box's last coordinate)."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        self.ids, self.labels, self.x = ids, labels, x
        edges = np.arange(0, len(ids), LEAF)
        self.lo, self.hi = [lo.astype(np.float64)], [hi.astype(np.float64)]
        self.least, self.most = [np.minimum.reduceat(labels, edges)], [np.maximum.reduceat(labels, edges)]
        while len(self.lo[-1]) > FANOUT:
            e = np.arange(0, len(self.lo[-1]), FANOUT)
            self.lo.append(np.minimum.reduceat(self.lo[-1], e))
            self.hi.append(np.maximum.reduceat(self.hi[-1], e))
            self.least.append(np.minimum.reduceat(self.least[-1], e))
            self.most.append(np.maximum.reduceat(self.most[-1], e))

    @staticmethod
    def packed(ids: np.ndarray, labels: np.ndarray, x: np.ndarray, axes: np.ndarray) -> tuple:
        """The order of the rows and the leaves' boxes; labels come sorted."""
        cuts = np.flatnonzero(np.diff(labels)) + 1
        runs = np.split(np.arange(len(ids)), cuts)
        order = np.concatenate([r[str_order(x[r], axes, LEAF)] for r in runs])
        edges = np.arange(0, len(ids), LEAF)
        return order, np.minimum.reduceat(x[order], edges), np.maximum.reduceat(x[order], edges)

    def bounds(self, q: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(least, most) inner product of each anchor (rows of q) with each box, by level."""
        plus, minus = np.maximum(q, 0), np.minimum(q, 0)
        return [(plus @ lo.T + minus @ hi.T, plus @ hi.T + minus @ lo.T) for lo, hi in zip(self.lo, self.hi, strict=True)]

    def search(self, q: np.ndarray, own: int, label: int, same: bool, low: np.ndarray, high: np.ndarray, k: int, bounds: list) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) of the k best in each score window [low, high], of the same label or of others; own is no candidate."""
        found = [(np.empty(0, np.int64), np.empty(0))] * len(low)
        bar = np.full(len(low), -np.inf)
        queue: list = []

        def push(level: int, a: int, b: int) -> None:
            least, most = self.least[level][a:b], self.most[level][a:b]
            lb, ub = bounds[level][0][a:b], bounds[level][1][a:b]
            fit = (least <= label) & (most >= label) if same else (least != label) | (most != label)
            top = np.minimum(ub[:, None], high)
            counts = fit[:, None] & (lb[:, None] <= high) & (ub[:, None] >= low) & (top >= bar)
            best = np.where(counts, top, -np.inf).max(1)
            for i in np.flatnonzero(best > -np.inf):
                heapq.heappush(queue, (-best[i], level, a + int(i)))

        push(len(self.lo) - 1, 0, len(self.lo[-1]))
        while queue:
            best, level, node = heapq.heappop(queue)
            if -best < bar.min():
                break
            if level:
                push(level - 1, node * FANOUT, min((node + 1) * FANOUT, len(self.lo[level - 1])))
                continue
            at = slice(node * LEAF, (node + 1) * LEAF)
            score = self.x[at] @ q
            ids = self.ids[at]
            use = np.flatnonzero(((self.labels[at] == label) == same) & (ids != own) & (score >= np.maximum(low, bar).min()) & (score <= high.max()))
            if not len(use):
                continue
            score, ids = score[use], ids[use]
            for w in range(len(low)):
                pick = (score >= low[w]) & (score <= high[w]) & (score >= bar[w])
                if pick.any():
                    i, s = np.concatenate([found[w][0], ids[pick]]), np.concatenate([found[w][1], score[pick]])
                    order = np.lexsort((i, -s))[:k]
                    found[w] = (i[order], s[order])
                    if len(order) == k:
                        bar[w] = s[order[-1]]
        return found


def _spread(batches):
    """dim, i, n, s, ss: sums of entry i and of its square, by length of vector."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for own, x in unpack(batch.column(0).to_pylist()):
            f = x.astype(np.float64)
            part = np.stack([np.full(x.shape[1], float(len(own))), f.sum(0), (f * f).sum(0)])
            total[x.shape[1]] = total.get(x.shape[1], 0) + part
    for dim, (n, s, ss) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array(n), pa.array(s), pa.array(ss)], ["dim", "i", "n", "s", "ss"])


def by_variance(rows: DataFrame) -> dict[int, np.ndarray]:
    """Coordinates by falling variance, for each length of vector; collects one number a coordinate."""
    g = rows.select("x").mapInArrow(_spread, "dim int, i int, n double, s double, ss double").groupBy("dim", "i")
    v = g.agg((F.sum("ss") / F.sum("n") - F.pow(F.sum("s") / F.sum("n"), 2)).alias("v")).collect()
    return {dim: np.array([r["i"] for r in sorted((r for r in v if r["dim"] == dim), key=lambda r: (-r["v"], r["i"]))]) for dim in {r["dim"] for r in v}}


def _lead(axes: dict[int, np.ndarray]):
    def run(batches):
        for batch in batches:
            raw = batch.column(2).to_pylist()
            dim, lead = np.empty(len(raw), np.int32), np.empty(len(raw), np.int64)
            for own, x in unpack(raw):
                dim[own], lead[own] = x.shape[1], x[:, axes[x.shape[1]][0]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dim), pa.array(lead)], ["id", "label", "x", "dim", "lead"])

    return run


def _trees(axes: dict[int, np.ndarray], most: int):
    """Trees of the rows of a partition, which come by length, label and leading coordinate."""
    names = [c.split()[0] for c in _TREE.split(", ")]

    def run(batches):
        made, held, size, now = 0, [], 0, None

        def tree():
            nonlocal made
            ids, labels = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            x = np.concatenate([h[2] for h in held])
            order, lo, hi = Tree.packed(ids, labels, x, axes[now])
            wide = width(x)
            cell = (TaskContext.get().partitionId() << 32) + made
            made += 1
            kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 3, pa.int32(), *[pa.binary()] * 2]
            row = [cell, now, ids[order].tobytes(), labels[order].tobytes(), x[order].astype(f"<i{wide}").tobytes(), wide, *(v.astype(f"<i{wide}").tobytes() for v in (lo, hi))]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            ids, labels = (batch.column(i).to_numpy() for i in (0, 1))
            for own, x in unpack(batch.column(2).to_pylist()):
                if held and (now != x.shape[1] or size + len(own) > most):
                    yield tree()
                    held, size = [], 0
                now = x.shape[1]
                held.append((ids[own], labels[own], x.astype(f"<i{width(x)}")))
                size += len(own)
        if held:
            yield tree()

    return run


_BLOCK = "dim int, n int, ids binary, labels binary, x binary, counts binary, pids binary, scores binary"


def _blocks(batches):
    """Anchors in blocks: ids, labels, vectors, and their positives (ids and scores) one after another."""
    names = [c.split()[0] for c in _BLOCK.split(", ")]
    held: dict[int, list] = {}

    def block(dim):
        ids, labels, x, counts, pids, scores = (np.concatenate(c) for c in zip(*held.pop(dim), strict=True))
        row = [dim, len(ids), *(v.tobytes() for v in (ids, labels, x, counts, pids, scores))]
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 6]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

    for batch in batches:
        ids, labels, raw = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
        found = batch.column(3).to_pylist()
        for own, x in unpack(raw):
            dim, mine = x.shape[1], [found[i] or [] for i in own]
            flat = [p for ps in mine for p in ps]
            part = (ids[own], labels[own], x, np.array([len(p) for p in mine], np.int32), np.array([p["positive_id"] for p in flat], np.int64), np.array([p["positive_score"] for p in flat], np.int64))
            held.setdefault(dim, []).append(part)
            if sum(len(p[0]) for p in held[dim]) >= BLOCK:
                yield block(dim)
    for dim in list(held):
        yield block(dim)


def _exact(x: np.ndarray, q: np.ndarray) -> bool:
    """Whether every partial sum of an inner product is a whole number that a double holds."""
    return float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1] < 2.0**53


def _meet(same: bool, positives: int, negatives: int, low: int, high: int):
    """Searches one tree for a group of blocks of anchors."""
    schema = "anchor_id positive_id positive_score" if same else "anchor_id positive_id positive_score negative_id negative_score"

    def run(key, trees, blocks):
        out: list[list] = [[] for _ in schema.split()]
        if trees.num_rows and blocks.num_rows:
            t = trees.to_pylist()[0]
            dim, kind = t["dim"], f"<i{t['wide']}"
            x, lo, hi = (np.frombuffer(t[c], kind).reshape(-1, dim) for c in ("x", "lo", "hi"))
            tree = Tree(np.frombuffer(t["ids"], np.int64), np.frombuffer(t["labels"], np.int64), x.astype(np.float64), lo, hi)
            for b in blocks.to_pylist():
                ids, labels, counts, pids, scores = (np.frombuffer(b[c], k) for c, k in (("ids", np.int64), ("labels", np.int64), ("counts", np.int32), ("pids", np.int64), ("scores", np.int64)))
                anchors = np.frombuffer(b["x"], np.int64).reshape(-1, dim)
                if not _exact(x, anchors):
                    raise ValueError("scores beyond 53 bits: use a smaller scale")
                q, end = anchors.astype(np.float64), np.cumsum(counts)
                bounds = tree.bounds(q)
                for a in range(len(ids)):
                    mine = [(one[a], two[a]) for one, two in bounds]
                    if same:
                        got = tree.search(q[a], ids[a], labels[a], True, np.array([-np.inf]), np.array([np.inf]), positives, mine)[0]
                        found = [(np.full(len(got[0]), ids[a]), got[0], got[1])]
                    else:
                        p, s = pids[end[a] - counts[a] : end[a]], scores[end[a] - counts[a] : end[a]]
                        # windows that whole numbers can fall into
                        bottom, top = -(-low * s // 100), high * s // 100
                        some = np.flatnonzero(bottom <= top)
                        if not len(some):
                            continue
                        got = tree.search(q[a], ids[a], labels[a], False, bottom[some].astype(float), top[some].astype(float), negatives, mine)
                        found = [(np.full(len(i), ids[a]), np.full(len(i), p[w]), np.full(len(i), s[w]), i, v) for w, (i, v) in zip(some, got, strict=True)]
                    for part in found:
                        for column, v in zip(out, part, strict=True):
                            column.append(v)
        cols = [pa.array(np.concatenate(c).astype(np.int64) if c else np.empty(0, np.int64)) for c in out]
        return pa.table(cols, names=schema.split())

    return run, ", ".join(f"{c} long" for c in schema.split())


def hard_negatives(
    df: DataFrame,
    chosen: str,
    ident: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: float = SCALE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; anchors are the rows that the SQL condition `chosen`
    (over id and label) picks. Labels are whole numbers."""
    spark = df.sparkSession
    tune(spark)
    usable = df.select(F.col(ident).alias("_id"), F.col(label).alias("_label"), F.col(vector).alias("_v")).where("_id is not null and _label is not null")
    rows = quantised(usable, {"_id": "long", "_label": "long"}, "_v", scale)
    one = rows.groupBy("_id").agg(F.min(F.struct("_label", "x")).alias("r")).select(F.col("_id").alias("id"), F.col("r._label").alias("label"), "r.x")
    rows = written(one, "rows")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    total = rows.count()
    if not total:
        return spark.createDataFrame([], schema)
    # no more range partitions than full trees of the least size, whatever the number of shuffle partitions
    axes, tasks = by_variance(rows), max(1, min(parted(spark), -(-total // TREE_LEAST)))
    most = min(TREE_MOST, max(TREE_LEAST, -(-total // (2 * tasks))))
    order = ["dim", "label", "lead", F.xxhash64("id"), "id"]
    led = rows.mapInArrow(_lead(axes), "id long, label long, x binary, dim int, lead long")
    sorted_rows = led.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    trees = written(sorted_rows.select("id", "label", "x").mapInArrow(_trees(axes, most), _TREE), "trees")
    cells = trees.groupBy("dim").agg(F.collect_list("cell").alias("cells"))
    anchors = rows.where(chosen)
    # one block of anchors is BLOCK rows, a group at most ANCHORS
    groups = max(1, -(-anchors.count() // ANCHORS))

    def searched(asked: DataFrame, same: bool) -> DataFrame:
        blocks = asked.mapInArrow(_blocks, _BLOCK).withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(groups)).cast("int"))
        blocks = written(blocks, "blocks")
        sent = blocks.join(cells, "dim").select(F.explode("cells").alias("cell"), "part", *[c.split()[0] for c in _BLOCK.split(", ")])
        met = trees.withColumn("part", F.explode(F.expr(f"sequence(0, {groups - 1})")))
        run, found = _meet(same, positives, negatives, low, high)
        got = written(met.groupBy("cell", "part").cogroup(sent.groupBy("cell", "part")).applyInArrow(run, found), "found")
        dropped(blocks)
        return got

    bare = anchors.repartition(tasks, "id").select("id", "label", "x", F.lit(None).cast("array<struct<positive_id:long,positive_score:long>>").alias("p"))
    own = searched(bare, True)
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    first = own.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= positives)
    first = first.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("p"))
    found = searched(anchors.join(first, anchors["id"] == first["anchor_id"]).select("id", "label", "x", "p"), False)
    dropped(rows, trees, own)
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

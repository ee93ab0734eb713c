"""N-gram Jaccard join by universe partitioning and the pigeonhole principle.

Sets of at least 75 % Jaccard similarity differ in at most (|a| + |b|) / 7 tokens. Sizes are grouped in bands of ratio 4/3, so
partners lie in one band or in neighbours. For each band the universe of tokens is cut by hash into m segments, m being
``SLACK`` times one more than the largest difference H allowed, so linked sets agree exactly in at least m - H segments. A set
emits the hash of each non-empty segment in its own band and, as a larger partner, in the band below.

Sets whose shared and empty segments are too few for any partner are done. The others go through two rounds:

1. Each set is verified against the sets that are the most central of many of its segments. That joins groups of copies,
   however large, by a few pairs a member.
2. Segments that lie in one such component only say nothing more and go; with them go all sets that are left with too few.
   Among the rest costs are allocated by frequency. Segments of at most ``COMMON`` sets are cheap: a pair of different
   components is a candidate if it agrees in as many of them as m - H leaves after the empty and the dear segments of both. A
   set whose empty and dear segments may be all that it shares makes up for them by one token of difference in as many other
   segments as are lacking, those of fewest tokens first: its segments and their one-deletion neighbourhoods probe the
   neighbourhoods and segments of all such sets. If these don't suffice, it also goes by as many of its dear segments as are
   still lacking, the rarest first. Sets that more than ``COMMON`` meet in one of these ways are compared in blocks of bounded
   size, together with those that meet the same most frequent set.

Candidate pairs are first compared by parity bitmaps, which differ in at most as many bits as the sets do in tokens; that rules most
false ones out by a fraction of a byte a token. The others are verified exactly on the shingles of the two texts, grouped by their
smaller document and salted where it has many. Equal sets are one set, found by two independent hashes of the set. No group of candidates is closed transitively.

Shingles are compared by 64-bit hashes. Null texts are empty; documents without words link with nothing. Rows with a null
doc_id keep their row, link with nothing and have no component. Rows that repeat a doc_id each keep their row and their
n_shingles; they are one document in the graph of links: what links to any of them links to all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.blobs import FLUSH, bucket_of, deal, low_bits
from tidemark.llm.shared import bucketed, components, dropped, forest, lean, parted, tune, written
from tidemark.llm.words import U, mix, shingle_sets

SHINGLE, SLACK, COMMON, GROUP = 5, 1.3, 48, 300_000


_STARTS = [1]
while _STARTS[-1] < 1 << 40:
    _STARTS.append(max(_STARTS[-1] + 1, -(-4 * _STARTS[-1] // 3)))
STARTS = np.array(_STARTS, dtype=np.int64)


def segments(band: int) -> tuple[int, int]:
    """(m, H) of the band: its sets, and partners up to the end of the next band."""
    u = int(STARTS[band + 1]) - 1
    most = min(int(STARTS[band + 2]) - 1, 4 * u // 3)
    h = (u + most) // 7
    return int(SLACK * (h + 1)) if h else 1, h


def signatures(tokens: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the non-empty segments in this band's partition, and how many tokens each holds."""
    m, _ = segments(band)
    t = np.sort(mix(tokens, band + 100))
    seg = (t >> U(32)) * U(m) >> U(32)
    begin = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
    sums = np.add.reduceat(mix(t, 1), begin)
    return mix(sums + seg[begin] * U(0x9E3779B97F4A7C15), band), np.diff(np.append(begin, len(t)))


def set_hashes(s: np.ndarray) -> tuple[int, int]:
    return int(mix(s, 11).sum()) - (1 << 63), int(mix(s, 12).sum()) - (1 << 63)


def parity(s: np.ndarray) -> bytes:
    """A bitmap of 2 to 4 bits a token (64 to 65,536 in all), each token turning one bit over. The bitmaps of two sets differ in no more bits
    than the sets do in tokens, whatever tokens they share."""
    bits = 1 << int(np.clip(np.ceil(np.log2(max(2 * len(s), 1))), 6, 16))
    return np.packbits((np.bincount((mix(s, 13) & U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """In how many bits two bitmaps differ; a longer one is folded onto the shorter one's length first."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _sets(batches):
    for batch in batches:
        n, a, b, bits = [], [], [], []
        for s in shingle_sets(batch.column(1), SHINGLE):
            x, y = set_hashes(s)
            n.append(len(s))
            a.append(x)
            b.append(y)
            bits.append(parity(s))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(bits, pa.binary())], ["doc_id", "n", "h1", "h2", "bits"])


def _near_enough(batches):
    """Pairs (a, b, n) whose bitmaps differ in no more bits than linked sets may in tokens."""
    for batch in batches:
        na, nb = batch.column(3).to_numpy(), batch.column(5).to_numpy()
        gap = np.array([differing(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(6).to_pylist(), strict=True)], np.int64)
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(gap <= (na + nb) // 7)) for c in batch.columns[:3]], ["a", "b", "n"])


def filtered(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that their bitmaps don't rule out: none that is linked goes, few of the others stay. Rows of one id stand for each other."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("one"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("two"))
    j = pairs.join(one, "a").join(two, "b").select("a", "b", "n", "na", "one", "nb", "two")
    return j.mapInArrow(_near_enough, "a long, b long, n long").groupBy("a", "b").agg(F.max("n").alias("n"))


_BLOB = "bucket int, sig binary, docs binary"
#: A document in a bucket: c0 and c1 signatures of either side are there, e0 and e1 segments of either side are empty.
_DOC = np.dtype([("doc", "<i8"), ("h", "<i8"), ("n", "<u4"), ("e0", "<u4"), ("e1", "<u4"), ("c0", "<u4"), ("c1", "<u4")])


def _emit(buckets: int):
    """One row a bucket for every FLUSH signatures: low hash bits in the order of its documents, and the documents' table."""

    def run(batches):
        seen: set[int] = set()
        docs, sigs, counts, held = [], [], [], 0

        def flush():
            h = np.concatenate(sigs)
            own = np.repeat(np.arange(len(counts), dtype=np.uint32), counts)
            order, at = deal(h, buckets)
            low, own = low_bits(h)[order], own[order]
            table = np.array(docs, dtype=np.int64)
            rows = []
            for i in range(buckets):
                mine = own[at[i] : at[i + 1]]
                if not len(mine):
                    continue
                begin = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
                of, place = np.unique(mine[begin] >> 1, return_inverse=True)
                out = np.zeros(len(of), dtype=_DOC)
                for k, name in enumerate(("doc", "h", "n", "e0", "e1")):
                    out[name] = table[of, k]
                count, side = np.diff(np.append(begin, len(mine))), mine[begin] & 1
                out["c0"][place[side == 0]] = count[side == 0]
                out["c1"][place[side == 1]] = count[side == 1]
                rows.append((i, low[at[i] : at[i + 1]].tobytes(), out.tobytes()))
            cols = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "sig", "docs"])

        for batch in batches:
            for doc, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), SHINGLE), strict=True):
                if not len(s) or doc is None:
                    continue
                h1, h2 = set_hashes(s)
                if (h1 ^ h2 << 1) in seen:
                    continue
                seen.add(h1 ^ h2 << 1)
                own = int(np.searchsorted(STARTS, len(s), "right")) - 1
                empty = [0, 0]
                for side in (0, 1):
                    sig = signatures(s, own - side)[0] if own >= side else np.empty(0, dtype=U)
                    empty[side] = segments(own - side)[0] - len(sig) if own >= side else 0
                    sigs.append(sig)
                    counts.append(len(sig))
                    held += len(sig)
                docs.append((doc, h1, len(s), *empty))
                if held >= FLUSH:
                    yield flush()
                    docs, sigs, counts, held = [], [], [], 0
        if held:
            yield flush()

    return run


_SHARED = "sig long, node long, side int, n long, m int, need int, empty int, sets int"


def parts_of(n: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Segments that the universe is cut into, by size and side of a set."""
    bands, place = np.unique(np.maximum(np.searchsorted(STARTS, n, "right") - 1 - side, 0), return_inverse=True)
    return np.array([segments(int(b))[0] for b in bands], dtype=np.int64)[place] if len(n) else np.empty(0, np.int64)


def needed(n: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Segments in which a set agrees at least with any partner: one of up to 4/3 its size, or a smaller one on side 1."""
    return parts_of(n, side) - np.where(side == 0, (n + 4 * n // 3) // 7, np.maximum(2 * n - 1, 0) // 7)


def _meet(batches):
    """Of one bucket at a time: each (segment, set) whose segment more than one distinct set has, and how many have it."""
    bucket, parts = None, []

    def out():
        sig = np.concatenate([np.frombuffer(p[0], np.uint32) for p in parts])
        docs = np.concatenate([np.frombuffer(p[1], _DOC) for p in parts])
        # equal sets from several tasks: the smallest document stands for them, the same in every bucket
        order = np.lexsort((docs["doc"], docs["n"], docs["h"]))
        d = docs[order]
        new = np.ones(len(d), dtype=bool)
        new[1:] = (d["h"][1:] != d["h"][:-1]) | (d["n"][1:] != d["n"][:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))
        stands = np.empty(len(docs), dtype=U)
        stands[order] = order[first]
        count = np.stack([docs["c0"], docs["c1"]], 1).ravel()
        key = sig.astype(U)
        del sig, d
        key <<= U(32)
        key |= np.repeat(np.stack([stands << U(1), stands << U(1) | U(1)], 1).ravel(), count)
        key.sort()
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        key = key[new]
        group = np.ones(len(key), dtype=bool)
        group[1:] = (key[1:] ^ key[:-1]) >> U(32) > 0
        begin = np.flatnonzero(group)
        size = np.diff(np.append(begin, len(key)))
        # sets whose empty segments alone may be all they share go on with all their segments
        bare = np.stack([docs[e] >= needed(docs["n"].astype(np.int64), np.full(len(docs), k)) for k, e in enumerate(("e0", "e1"))], 1).ravel()
        owner = (key & U(0xFFFFFFFF)).astype(np.uint32)
        many = np.repeat(size, size)
        keep = np.flatnonzero((many > 1) | bare[owner])
        key, o, many = key[keep], owner[keep].astype(np.int64), many[keep]
        doc, side = docs[o >> 1], o & 1
        empty = np.where(side == 0, doc["e0"], doc["e1"]).astype(np.int64)
        n = doc["n"].astype(np.int64)
        cols = [(key >> U(32)).astype(np.int64) | np.int64(bucket) << 32, doc["doc"], side, n, parts_of(n, side), needed(n, side), empty, many]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), *[pa.int32()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)).cast(k) for c, k in zip(cols, kinds, strict=True)], ["sig", "node", "side", "n", "m", "need", "empty", "sets"])

    for batch in batches:
        for b, *rest in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if b != bucket and parts:
                yield out()
                parts = []
            bucket = b
            parts.append(rest)
    if parts:
        yield out()


def linked(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs with 100 * intersection >= 75 * union, by inverted lists of the tokens that several sets have."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    token = np.concatenate(sets) if sets else np.empty(0, dtype=U)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.empty(0, np.int64)
    df = np.diff(np.append(begin, len(token)))
    many = df > 1
    begin, df = begin[many], df[many]
    k = len(sets)
    found_a, found_b = [], []
    # counts of a strip of rows at a time: a dense strip of k columns is the most that is held
    strip = max(1, (1 << 20) // max(k, 1))
    # tokens of very many sets are counted by a matrix product, the others by their lists
    dense = np.flatnonzero(df > 64)
    d_begin, d_df = begin[dense], df[dense]
    begin, df = np.delete(begin, dense), np.delete(df, dense)
    listed = np.repeat(np.arange(len(df)), df)
    where = np.arange(len(listed)) - np.repeat(np.cumsum(df) - df, df) + np.repeat(begin, df)
    own = owner[where]
    by_owner = np.argsort(own, kind="stable")
    starts = np.searchsorted(own[by_owner], np.arange(k + 1))
    for lo in range(0, k, strip):
        hi = min(k, lo + strip)
        mine = by_owner[starts[lo] : starts[hi]]
        if not len(mine) and not len(dense):
            continue
        count = np.zeros((hi - lo) * k, dtype=np.int32)
        lens = df[listed[mine]]
        step = max(1, int((1 << 20) // max(1, lens.max(initial=1))))
        for c in range(0, len(mine), step):
            rows, n = mine[c : c + step], lens[c : c + step]
            partner = np.repeat(begin[listed[rows]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            count += np.bincount((np.repeat(own[rows], n) - lo) * k + owner[partner], minlength=len(count)).astype(np.int32)
        both = count.reshape(hi - lo, k)
        for c in range(0, len(dense), 2048):
            n = d_df[c : c + 2048]
            m = np.zeros((k, len(n)), dtype=np.float32)
            m[owner[np.repeat(d_begin[c : c + 2048], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)], np.repeat(np.arange(len(n)), n)] = 1
            both = both + (m[lo:hi] @ m.T).astype(np.int32)
        a, b = np.nonzero(both)
        a, b, c = a + lo, b, both[a, b].astype(np.int64)
        ok = (a < b) & (100 * c >= 75 * (size[a] + size[b] - c))
        found_a.append(a[ok])
        found_b.append(b[ok])
    return np.concatenate(found_a) if found_a else np.empty(0, np.int64), np.concatenate(found_b) if found_b else np.empty(0, np.int64)


def _block_links(key, table):
    """Links among all sets of a block, or of a pair of blocks, as a forest."""
    ids = table["node"].to_numpy()
    a, b = linked(list(shingle_sets(table["text"], SHINGLE)))
    a, b = (ids[a], ids[b]) if len(a) else (np.empty(0, np.int64), np.empty(0, np.int64))
    keep = a != b
    a, b = forest(a[keep], b[keep]) if keep.any() else (a[keep], b[keep])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _pair_links(key, table):
    """Of rows (a, cut, node, text): the nodes whose sets link with that of a."""
    lead, cut, node = (table[c].to_numpy() for c in ("a", "cut", "node"))
    sets = list(shingle_sets(table["text"], SHINGLE))
    order = np.lexsort((node != lead, cut, lead))
    new = np.flatnonzero(np.concatenate([[True], (lead[order][1:] != lead[order][:-1]) | (cut[order][1:] != cut[order][:-1])]))
    found_a, found_b = [], []
    for lo, hi in zip(new.tolist(), [*new[1:].tolist(), len(order)], strict=True):
        own = order[lo:hi]
        leads = own[node[own] == lead[own[0]]]
        members = own[len(leads) :]
        if not len(members):
            continue
        size = np.array([len(sets[i]) for i in members])
        tokens = np.concatenate([sets[i] for i in members])
        for s in (sets[i] for i in leads):
            if not len(s):
                continue
            at = np.minimum(np.searchsorted(s, tokens), len(s) - 1)
            both = np.bincount(np.repeat(np.arange(len(members)), size), s[at] == tokens, len(members)).astype(np.int64)
            hit = members[100 * both >= 75 * (size + len(s) - both)]
            found_a.append(lead[hit])
            found_b.append(node[hit])
    none = np.empty(0, np.int64)
    return pa.table({"a": pa.array(np.concatenate(found_a) if found_a else none, pa.int64()), "b": pa.array(np.concatenate(found_b) if found_b else none, pa.int64())})


_PROBES = "key long, node long, role int"


def _neighbourhoods(buckets: int):
    """Keys of the doubtful sets. Roles: 0 index of segments, 1 index of one-deletion neighbourhoods, 2 probe of the latter by a
    segment, 3 probe of the former by a neighbourhood; of those whom these don't suffice: 4 index of dear segments, 5 probe of them,
    6 the band, where even that is too little."""

    def run(batches):
        for batch in batches:
            keys, nodes, roles = [], [], []

            def add(node, role, h):
                keys.append(h.view(np.int64) if role > 3 else mix(h, 61 + (role in (1, 2))).view(np.int64))
                nodes.append(np.full(len(h), node))
                roles.append(np.full(len(h), role))

            sides = batch.column(2).to_pylist()
            for node, s, wanted in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), SHINGLE), sides, strict=True):
                for want in wanted if len(s) else ():
                    band = int(np.searchsorted(STARTS, len(s), "right")) - 1 - want["side"]
                    if band < 0:
                        continue
                    m, _ = segments(band)
                    t = np.sort(mix(s, band + 100))
                    seg = (t >> U(32)) * U(m) >> U(32)
                    begin = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
                    size = np.diff(np.append(begin, len(t)))
                    part = mix(t, 1)
                    sums = np.add.reduceat(part, begin)
                    name = lambda x, k: mix(x + k * U(0x9E3779B97F4A7C15), band)  # noqa: B023,E731
                    exact = name(sums, seg[begin])
                    short = name(np.repeat(sums, size) - part, seg)
                    add(node, 0, exact)
                    add(node, 1, short[np.repeat(size, size) > 1])
                    tag = bucket_of(exact, buckets) << 32 | low_bits(exact).astype(np.int64)
                    dear = np.array([x["sig"] for x in sorted(want["dear"], key=lambda x: (x["sets"], x["sig"]))], dtype=np.int64)
                    free = np.flatnonzero((size > 1) & ~np.isin(tag, dear))
                    chosen = free[np.argsort(size[free], kind="stable")[: want["lack"]]]
                    add(node, 2, exact[chosen])
                    add(node, 3, short[np.isin(np.repeat(np.arange(len(size)), size), chosen)])
                    lack = want["lack"] - len(chosen)
                    if lack > 0:
                        add(node, 4, dear)
                        add(node, 5, dear[:lack])
                    if lack > len(dear):
                        add(node, 6, np.array([band], dtype=np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(nodes), pa.int64()), pa.array(np.concatenate(roles), pa.int32())], ["key", "node", "role"])

    return run


def enough(rows: DataFrame) -> DataFrame:
    """rows (segments of sets) of those sets and sides that hold enough of them, with the empty ones, for a partner; central
    tells how many sets share theirs, over all segments. The rows of a set, no more than its segments, meet in one shuffle: counts that tasks
    combine before a second one would be as many as the rows once there are more tasks than segments."""
    own = Window.partitionBy("node", "side", "n")
    have, most, least_need = F.count(F.lit(1)).over(own), F.max("empty").over(own), F.max("need").over(own)
    some = rows.select("*", F.sum("sets").over(own).alias("central"), (have + most >= least_need).alias("alive"))
    return some.where("alive").drop("alive")


def stars(rows: DataFrame) -> DataFrame:
    """Pairs (a, b, n): each set with those that are the most central of its segments, if they share enough of them. Of edited
    copies the text that they were made from is the most central."""
    lead = rows.groupBy("sig").agg(F.max(F.struct("central", "n", "node")).alias("lead"))
    j = rows.join(lead.select("sig", F.col("lead.node").alias("a"), F.col("lead.n").alias("an")), "sig").where("a <> node and 4 * n >= 3 * an and 4 * an >= 3 * n")
    j = j.groupBy("a", F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("agree"), F.max(F.expr("m - (an + n) div 7 - empty")).alias("want"), F.max("n").alias("n"))
    return j.where("agree >= want").select("a", "b", "n")


def between(rows: DataFrame) -> DataFrame:
    """rows of the segments that more than one component has."""
    spread = rows.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("sets"))
    # sets whose empty segments may be all that they share stay whatever their segments are
    return rows.join(spread, "sig").where("lo < hi or empty >= need").drop("lo", "hi")


def candidates(s: DataFrame, text: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, n) of sets of different components that may be linked, and groups (key, node) to be compared in blocks."""
    dear = F.col("sets") > COMMON
    held = s.groupBy("node", "side", "n").agg(F.sum(dear.cast("int")).alias("hot"))
    s = s.join(held, ["node", "side", "n"])
    few = s.where(~dear).select("sig", "node", "side", "n", "m", "empty", "hot", "comp")
    a, b = few.alias("a"), few.alias("b")
    near = F.expr("a.sig = b.sig and a.node < b.node and a.comp <> b.comp and a.side + b.side < 2 and 4 * a.n >= 3 * b.n and 4 * b.n >= 3 * a.n")
    left = F.expr("a.m - (a.n + b.n) div 7 - least(a.empty, b.empty) - least(a.hot, b.hot)")
    pairs = a.join(b, near).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"), F.col("b.n").alias("n"), left.alias("least"))
    pairs = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("agree"), F.min("least").alias("least"), F.max("n").alias("n")).where("agree >= least").select("a", "b", "n")
    lack = F.max(F.col("empty") + F.col("hot") - F.col("need") + 1).alias("lack")
    sides = s.where("empty + hot >= need").groupBy("node", "side", "n", "comp").agg(lack, F.collect_list(F.when(dear, F.struct("sig", "sets"))).alias("dear"))
    sides = written(sides.groupBy("node", "comp").agg(F.collect_list(F.struct("side", "lack", "dear")).alias("sides"), F.max("n").alias("n")), "doubtful")
    keys = text.join(sides, F.col("node") == F.col("doc_id")).select("node", "text", "sides").mapInArrow(lean(_neighbourhoods(buckets)), _PROBES)
    kind = F.when(F.col("role") < 4, 0).when(F.col("role") < 6, 4).otherwise(6).alias("kind")
    keys = keys.groupBy("key", "node", kind).agg(F.max(F.col("role").isin(2, 3, 5, 6).cast("int")).alias("probe"))
    keys = written(keys.join(sides.select("node", "comp", "n"), "node"), "neighbourhoods")
    met = keys.groupBy("key", "kind").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("sets"), F.max("probe").alias("probed"))
    keys = keys.join(met.where("lo < hi and probed = 1").select("key", "kind", "sets"), ["key", "kind"])
    c, d = keys.where(~dear).alias("c"), keys.where(~dear).alias("d")
    close = F.expr("c.key = d.key and c.kind = d.kind and c.node < d.node and c.comp <> d.comp and c.probe + d.probe > 0 and 4 * c.n >= 3 * d.n and 4 * d.n >= 3 * c.n")
    close = c.join(d, close).select(F.col("c.node").alias("a"), F.col("d.node").alias("b"), F.col("d.n").alias("n"))
    # dear keys are many, but those of one group of texts share their most frequent member: one group for each of these
    hot = keys.where(dear)
    weight = hot.groupBy("node").agg(F.count(F.lit(1)).alias("keys"))
    hot = hot.join(weight, "node")
    lead = hot.groupBy("key", "kind").agg(F.max(F.struct("keys", "node")).alias("lead"))
    groups = hot.join(lead, ["key", "kind"]).select(F.col("lead.node").alias("component"), "node").distinct()
    return pairs.union(close).groupBy("a", "b").agg(F.max("n").alias("n")), groups


def classes(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, its own included)."""
    spark = documents.sparkSession
    tune(spark)
    buckets = parted(spark)
    every = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = written(every.mapInArrow(lean(_sets), "doc_id long, n long, h1 long, h2 long, bits binary"), "sets")
    text = every.where("doc_id is not null")
    blobs = text.mapInArrow(lean(_emit(buckets)), _BLOB).repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket")
    shared = written(blobs.mapInArrow(lean(_meet), _SHARED), "shared")
    alive = written(enough(shared), "alive")
    dropped(shared)
    # texts that may link are dealt by doc_id once; the three joins that read them move ids only
    # dealt before the join, whose kind then doesn't matter: a bucket is one file, not one of each task
    some = text.repartition(buckets, "doc_id").join(alive.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    with bucketed(some, "texts", "doc_id", buckets) as text:
        # round one: each set with the most central ones
        near = written(filtered(stars(alive), sets), "near")
        joined = components(pair_links(near, text, buckets))
        first = written(joined, "first")
        dropped(near, joined)
        # round two: what may link different components
        comp = F.coalesce("component", F.col("node")).alias("comp")
        rest = alive.join(first, "node", "left").select("sig", "node", "side", "n", "m", "need", "empty", comp)
        rest = written(between(enough(between(rest)).drop("sets", "central")), "rest")
        dropped(alive)
        pairs, groups = candidates(rest, text, buckets)
        pairs, groups = written(filtered(pairs, sets), "candidates"), written(groups, "groups")
        dropped(rest)
        links = written(pair_links(pairs, text, buckets).union(block_links(groups, sets, text, buckets)), "found")
    # equal sets: each document with the smallest of its set
    some = sets.where("n > 0 and doc_id is not null")
    same = some.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("b"))
    same = some.join(same, ["n", "h1", "h2"]).select(F.col("doc_id").alias("a"), "b").where("a <> b")
    comp = components(links.union(first.select("node", "component")).union(same))
    dropped(pairs, groups, first, links)
    out = sets.join(comp, sets.doc_id == comp.node, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def pair_links(pairs: DataFrame, text: DataFrame, buckets: int) -> DataFrame:
    """The pairs (a, b; n: size of b's set) that are linked. Both texts of a pair meet once, many pairs in one group."""
    weight = F.sum("n").alias("n")
    packs = max(buckets, int((pairs.agg(weight).first()[0] or 0) * 2 // GROUP))
    hot = pairs.groupBy("a").agg(F.ceil(F.sum("n") / GROUP).alias("cuts")).where("cuts > 1")
    p = pairs.join(hot, "a", "left").select("a", F.pmod(F.xxhash64("b"), F.coalesce("cuts", F.lit(1))).alias("cut"), "b")
    want = p.select("a", "cut", F.col("b").alias("node")).union(p.select("a", "cut", F.col("a").alias("node")).distinct())
    rows = want.join(text, want.node == text.doc_id).select(F.pmod(F.xxhash64("a", "cut"), F.lit(packs)).alias("g"), "a", "cut", "node", "text")
    return rows.groupBy("g").applyInArrow(_pair_links, "a long, b long")


def block_links(near: DataFrame, sets: DataFrame, text: DataFrame, buckets: int) -> DataFrame:
    """Links among the nodes of each group (node, component), as forests; large groups are cut into blocks of size bands."""
    band = F.floor(F.log("n") / F.log(F.lit(4 / 3)) + 1e-9).cast("long")
    g = near.join(sets.groupBy(F.col("doc_id").alias("node")).agg(F.max("n").alias("n")), "node").select("node", "component", "n", band.alias("band"))
    whole = g.groupBy("component").agg(F.sum("n").alias("weight"))
    g = g.join(whole, "component")
    small = g.where(F.col("weight") <= GROUP)
    packs = F.greatest(F.lit(1), F.ceil(F.lit(2.0) * F.col("all") / GROUP)).cast("int")
    total = small.agg(F.sum("n").alias("all"))
    packs = total.select(packs).first()[0] or 1
    small = small.select("node", F.pmod(F.xxhash64("component"), F.lit(max(packs, buckets))).alias("g"), F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"))
    big = g.where(F.col("weight") > GROUP)
    per = big.groupBy("component", "band").agg(F.ceil(F.sum("n") * 2 / GROUP).alias("blocks"))
    ahead = per.select("component", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    behind = per.select("component", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    per = per.join(ahead, ["component", "band"], "left").join(behind, ["component", "band"], "left").na.fill(0, ["above", "below"])
    big = big.join(per, ["component", "band"]).withColumn("own", F.col("band") * 1_000_000 + F.pmod(F.xxhash64("node"), F.col("blocks")))
    # blocks of the own band and of both neighbours: each pair of blocks is one group
    span = lambda step, count: F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col(count)), lambda x: x < F.col(count)), lambda x: (F.col("band") + step) * 1_000_000 + x)
    big = big.select("node", "component", "own", F.explode(F.concat(span(0, "blocks"), span(1, "above"), span(-1, "below"))).alias("other"))
    big = big.select("node", F.col("component").alias("g"), (F.least("own", "other") + 1).alias("i"), (F.greatest("own", "other") + 1).alias("j"))
    rows = small.union(big).join(text, F.col("node") == text.doc_id).select("g", "i", "j", "node", "text")
    return rows.groupBy("g", "i", "j").applyInArrow(_block_links, "a long, b long")

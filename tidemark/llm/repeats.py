"""Substring dedup by fixed-block anchors.

A window of ``WINDOW`` = 50 words holds a whole block of ``ANCHOR`` = 25 words of any text that is cut into blocks from its
start. So the non-overlapping blocks of every document are the index, and every rolling run of 25 words of every document
probes it. Index and probes are hashes, dealt by hash to buckets; a hash that is a block somewhere and occurs in two different
documents is a hit. Each hit is extended to the windows around it: their hashes meet by hash, and a window that also starts in a
document of smaller id marks its words. Overlapping marked windows are the maximal exact repeats, and their words go.

Equal documents are settled first, by a hash of the whole word sequence: of them only the smallest can keep words. What a map
task can decide alone (both documents are in its hands) it decides, and sends one record for the group, so a passage that a third
of all documents share costs one record a task. Windows are compared by 64-bit hashes. All counts are over all documents.

Null texts have no words. Rows with a null doc_id lose nothing and take nothing. Documents of fewer than 50 words lose nothing.
Rows that repeat a doc_id each keep their row and are judged by themselves: only windows in documents of smaller id count.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blobs import FLUSH, bucket_of, deal, low_bits
from tidemark.llm.shared import parted, tune, written
from tidemark.llm.words import U, documents, mix, rolling

WINDOW, ANCHOR = 50, 25
_ROWS = "bucket int, doc long, x binary, y binary, docs binary"
_KEYS = ["bucket", "doc", "x", "y", "docs"]
_KINDS = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _KEYS)


def sequence_hash(w: np.ndarray) -> tuple[int, int]:
    place = mix(np.arange(len(w), dtype=U), 3)
    return int(mix(w + place, 4).sum()) - (1 << 63), int(mix(w ^ place, 5).sum()) - (1 << 63)


def _whole(batches):
    for batch in batches:
        out = []
        for _, w, first in documents(batch.column(1), False):
            out += [(hi - lo, *sequence_hash(w[lo:hi])) for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        cols = list(zip(*out, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", "n", "h1", "h2"])


def tag(h: np.ndarray, buckets: int) -> np.ndarray:
    """What the hits of stage one are known by: bucket and 31 bits below it."""
    return bucket_of(h, buckets) << 32 | (low_bits(h) & np.uint32(0xFFFFFFFE)).astype(np.int64)


def _groups(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))


def _by_owner(owner: np.ndarray, values: np.ndarray):
    """(owner, its values) for each owner."""
    order = np.argsort(owner, kind="stable")
    owner, values = owner[order], values[order]
    begin = _groups(owner)
    for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(owner)], strict=True):
        yield int(owner[a]), values[a:b]


def _probe(buckets: int):
    """Per bucket: probes (low bit: it is a block of its document) with their owners; and rows of hits settled here."""

    def run(batches):
        seen: set[int] = set()
        docs, runs, held = [], [], 0

        def flush():
            same = np.array(docs, dtype=np.int64)
            h = np.concatenate(runs)
            size = np.array([len(r) for r in runs])
            own = np.repeat(np.arange(len(runs), dtype=np.uint32), size)
            place = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
            name = tag(h, buckets)
            order = np.argsort(name, kind="stable")
            name, own, block = name[order], own[order], place[order] % ANCHOR == 0
            begin = _groups(name)
            count = np.diff(np.append(begin, len(name)))
            mine = np.logical_or.reduceat(block, begin) & (np.minimum.reduceat(own, begin) != np.maximum.reduceat(own, begin))
            inside = np.repeat(mine, count)
            rows = [(-1, int(same[o]), np.unique(v).tobytes(), b"", b"") for o, v in _by_owner(own[inside], name[inside])] if inside.any() else []
            # of a settled group its first record goes on, as a block; all records of the others
            send = ~inside
            send[begin[mine]] = True
            block = block | inside
            name, own, block = name[send], own[send], block[send]
            at = np.searchsorted(name >> 32, np.arange(buckets + 1))
            low = (name & 0xFFFFFFFF).astype(np.uint32) | block
            table = same.tobytes()
            rows += [(i, None, low[at[i] : at[i + 1]].tobytes(), own[at[i] : at[i + 1]].tobytes(), table) for i in range(buckets) if at[i + 1] > at[i]]
            return _batch(rows)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, w, first in documents(batch.column(1), False):
                grams = rolling(w, ANCHOR)
                for i, (lo, hi) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True), a):
                    if hi - lo < WINDOW or ids[i] is None:
                        continue
                    h1, h2 = sequence_hash(w[lo:hi])
                    if (h1 ^ h2 << 1) in seen:
                        continue
                    seen.add(h1 ^ h2 << 1)
                    docs.append(h1)
                    runs.append(grams[lo : hi - ANCHOR + 1])
                    held += hi - lo
                if held >= FLUSH:
                    yield flush()
                    docs, runs, held = [], [], 0
        if held:
            yield flush()

    return run


_PACKED = "bucket int, docs binary, counts binary, items binary"


def _bucketed(decide, buckets: int):
    """Feeds decide the rows of one bucket at a time; what it finds for each document, and what was settled before (bucket < 0),
    is packed by a hash of the document: a few large rows, however many documents there are."""

    def run(batches):
        found, held = [], 0

        def packed():
            docs = np.array([d for d, _ in found], dtype=np.int64)
            to = (mix(docs.astype(U), 21) % U(buckets)).astype(np.int64)
            rows = []
            for t, own in _by_owner(to, np.arange(len(docs))):
                items = [found[i][1] for i in own]
                rows.append((t, docs[own].tobytes(), np.array([len(x) for x in items], dtype=np.uint32).tobytes(), b"".join(items)))
            cols = zip(*rows, strict=True)
            kinds = (pa.int32(), *[pa.binary()] * 3)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["bucket", "docs", "counts", "items"])

        bucket, parts = -1, []
        for batch in batches:
            for b, doc, x, y, docs in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if b < 0:
                    found.append((doc, x))
                    held += len(x)
                else:
                    if b != bucket and parts:
                        for d, v in decide(bucket, parts):
                            found.append((d, v))
                            held += len(v)
                        parts = []
                    bucket = b
                    parts.append((x, y, docs))
                if held >= 8 * FLUSH:
                    yield packed()
                    found, held = [], 0
        if parts:
            found += decide(bucket, parts)
        if found:
            yield packed()

    return run


def _by_document(batches):
    """(doc, items) of all packed rows of one bucket."""
    bucket, parts = None, []

    def out():
        docs = np.concatenate([np.frombuffer(p[0], np.int64) for p in parts])
        items = []
        for _, counts, raw in parts:
            end = np.cumsum(np.frombuffer(counts, np.uint32).astype(np.int64))
            items += [raw[e - c : e] for e, c in zip(end.tolist(), np.frombuffer(counts, np.uint32).tolist(), strict=True)]
        got = [(d, b"".join(items[i] for i in own)) for d, own in _by_owner(docs, np.arange(len(docs)))]
        return pa.RecordBatch.from_arrays([pa.array([d for d, _ in got], pa.int64()), pa.array([x for _, x in got], pa.binary())], ["doc", "x"])

    for batch in batches:
        for b, *rest in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if b != bucket and parts:
                yield out()
                parts = []
            bucket = b
            parts.append(rest)
    if parts:
        yield out()


def _hits(bucket, parts):
    low = np.concatenate([np.frombuffer(x, np.uint32) for x, _, _ in parts])
    tables = [np.frombuffer(d, np.int64) for _, _, d in parts]
    shift = np.cumsum([0, *[len(t) for t in tables]])
    table = np.concatenate(tables)
    own = np.concatenate([np.frombuffer(y, np.uint32).astype(np.int64) + s for (_, y, _), s in zip(parts, shift, strict=False)])
    # probes of no block go early, by a bitmap of 24 bits of the blocks' hashes
    block = np.unique(low[low & 1 == 1] >> 1)
    bitmap = np.zeros(1 << 24, dtype=bool)
    bitmap[block & 0xFFFFFF] = True
    near = np.flatnonzero(bitmap[low >> 1 & 0xFFFFFF])
    near = near[np.isin(low[near] >> 1, block)]
    order = near[np.argsort(low[near] >> 1, kind="stable")]
    if not len(order):
        return []
    name, own = low[order] >> 1, own[order]
    begin = _groups(name)
    text = table[own]
    many = np.minimum.reduceat(text, begin) != np.maximum.reduceat(text, begin)
    inside = np.repeat(many, np.diff(np.append(begin, len(name))))
    if not inside.any():
        return []
    tags = np.int64(bucket) << 32 | name[inside].astype(np.int64) << 1
    # the same sequence from several tasks is one owner
    return [(int(o), np.unique(v).tobytes()) for o, v in _by_owner(text[inside], tags)]


def _extend(buckets: int):
    """Of documents with hits: the hashes of the windows that hold one, by bucket; and rows of windows settled here."""

    def run(batches):
        ids, names, spots, hashes, held = [], [], [], [], 0

        def flush():
            doc, name = np.array(ids, dtype=np.int64), np.array(names, dtype=np.int64)
            size = [len(s) for s in spots]
            own = np.repeat(np.arange(len(ids)), size)
            h, place = np.concatenate(hashes), np.concatenate(spots).astype(np.uint32)
            order = np.lexsort((doc[own], h))
            h, own, place = h[order], own[order], place[order]
            begin = _groups(h)
            first = np.repeat(doc[own[begin]], np.diff(np.append(begin, len(h))))
            later = doc[own] > first
            rows = [(-1, int(name[o]), v.tobytes(), b"", b"") for o, v in _by_owner(own[later], place[later])] if later.any() else []
            h, own, place = h[~later], own[~later], place[~later]
            order, at = deal(h, buckets)
            h, own, place = h[order], own[order], place[order]
            # a document may hold a window twice: both are records of its smallest holder
            full = np.empty(len(h), dtype=[("h", "<u8"), ("own", "<u4"), ("place", "<u4")])
            full["h"], full["own"], full["place"] = h, own, place
            table = np.stack([doc, name], 1).tobytes()
            rows += [(i, None, full[at[i] : at[i + 1]].tobytes(), b"", table) for i in range(buckets) if at[i + 1] > at[i]]
            return _batch(rows)

        for batch in batches:
            hits = batch.column(2).to_pylist()
            doc_ids, sequences = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            for a, w, first in documents(batch.column(1), False):
                short, long = rolling(w, ANCHOR), rolling(w, WINDOW)
                for i, (lo, hi) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True), a):
                    last = hi - lo - WINDOW
                    # another row of that id
                    if last < 0 or sequence_hash(w[lo:hi])[0] != sequences[i]:
                        continue
                    known = np.frombuffer(hits[i], np.int64)
                    at = np.flatnonzero(np.isin(tag(short[lo : hi - ANCHOR + 1], buckets), known))
                    if not len(at):
                        continue
                    step = np.zeros(hi - lo + 2, dtype=np.int32)
                    np.add.at(step, np.maximum(at - (WINDOW - ANCHOR), 0), 1)
                    np.add.at(step, at + 1, -1)
                    spot = np.flatnonzero(np.cumsum(step)[: last + 1] > 0)
                    if not len(spot):
                        continue
                    ids.append(doc_ids[i])
                    names.append(sequences[i])
                    spots.append(spot)
                    hashes.append(long[lo + spot])
                    held += len(spot)
                if held >= FLUSH:
                    yield flush()
                    ids, names, spots, hashes, held = [], [], [], [], 0
        if held:
            yield flush()

    return run


def _later(bucket, parts):
    record = [("h", "<u8"), ("own", "<u4"), ("place", "<u4")]
    full = [np.frombuffer(x, record) for x, _, _ in parts]
    owner = np.concatenate([np.frombuffer(d, np.int64).reshape(-1, 2)[f["own"]] for f, (_, _, d) in zip(full, parts, strict=True)])
    full = np.concatenate(full)
    order = np.lexsort((owner[:, 0], full["h"]))
    h, doc, name, place = full["h"][order], owner[order, 0], owner[order, 1], full["place"][order]
    begin = _groups(h)
    later = doc > np.repeat(doc[begin], np.diff(np.append(begin, len(h))))
    return [(d, v.tobytes()) for d, v in _by_owner(name[later], place[later])] if later.any() else []


def marked(text: DataFrame) -> DataFrame:
    """doc_id, marks: array of (h1, copy, places) for the sequences of the id that lose words - copy: equal to a smaller document;
    places: a binary of uint32, the starts of repeated windows. alone: the id has no other sequence."""
    spark = text.sparkSession
    buckets = parted(spark)
    usable = text.where("doc_id is not null")
    whole = written(usable.mapInArrow(_whole, "doc_id long, n long, h1 long, h2 long").distinct(), "sequences")
    several = whole.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    long = whole.where(F.col("n") >= WINDOW)
    least = written(long.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("least")), "least")
    deal_out = lambda rows: rows.repartitionById(buckets, F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("doc"), F.lit(buckets))).otherwise(F.col("bucket")).cast("int")).sortWithinPartitions("bucket")

    def gathered(rows: DataFrame, decide, name: str) -> DataFrame:
        packed = deal_out(rows).mapInArrow(_bucketed(decide, buckets), _PACKED)
        return written(packed.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(_by_document, "doc long, x binary"), name)

    # hits by sequence; the smallest of equal documents stands for them
    hits = gathered(usable.mapInArrow(_probe(buckets), _ROWS), _hits, "hits")
    hits = hits.join(least, hits.doc == least.h1).select("least", "x", "h1")
    found = usable.join(hits, usable.doc_id == hits.least).select("doc_id", "text", "x", "h1")
    places = gathered(found.mapInArrow(_extend(buckets), _ROWS), _later, "windows")
    copies = long.join(least, ["n", "h1", "h2"]).where("doc_id > least").select("doc_id", "h1", F.lit(True).alias("copy"), F.lit(None).cast("binary").alias("x"))
    own = places.join(least, places.doc == least.h1).select(F.col("least").alias("doc_id"), "h1", F.lit(False).alias("copy"), "x")
    marks = copies.union(own).groupBy("doc_id").agg(F.collect_list(F.struct("h1", "copy", "x")).alias("marks"))
    return marks.join(several, "doc_id", "left").select("doc_id", "marks", F.col("rows").isNull().alias("alone"))


def kept_words(raw: bytes, marks: list[dict] | None, alone: bool | None) -> tuple[int, list[bytes]]:
    """The number of words, and those that stay."""
    w = raw.split()
    if not marks or len(w) < WINDOW:
        return len(w), w
    if not alone:
        _, words, _ = next(documents(pa.array([raw]), False))
        marks = [m for m in marks if m["h1"] == sequence_hash(words)[0]]
    if any(m["copy"] for m in marks):
        return len(w), []
    if not marks:
        return len(w), w
    at = np.frombuffer(b"".join(m["x"] for m in marks), np.uint32).astype(np.int64)
    step = np.zeros(len(w) + WINDOW + 1, dtype=np.int32)
    np.add.at(step, at, 1)
    np.add.at(step, at + WINDOW, -1)
    return len(w), [w[i] for i in np.flatnonzero(np.cumsum(step)[: len(w)] == 0)]


def _digest(batches):
    for batch in batches:
        n, gone, sha = [], [], []
        for raw, marks, alone in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            k, kept = kept_words(raw or b"", marks, alone)
            n.append(k)
            gone.append(k - len(kept))
            sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha)], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _cut(batches):
    for batch in batches:
        out = [None if raw is None else b" ".join(kept_words(raw, marks, alone)[1]).decode() for raw, marks, alone in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "kept_text"])


def _joined(df: DataFrame) -> DataFrame:
    tune(df.sparkSession)
    text = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return text.join(marked(text), "doc_id", "left").select("doc_id", F.col("text").cast("binary").alias("text"), "marks", "alone")


def removed(df: DataFrame) -> DataFrame:
    """doc_id, kept_text: each text without its repeated words, one space between words; null stays null."""
    return _joined(df).mapInArrow(_cut, "doc_id long, kept_text string")


def digest(df: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return _joined(df).mapInArrow(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")

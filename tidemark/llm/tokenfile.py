"""Token ids on disk with Elias-Fano document boundaries.

A file holds blocks of consecutive documents in doc_id order. A block is the concatenated ids (2 bytes each where the
vocabulary allows, else 4) and two Elias-Fano sequences: the running counts of ids at the document ends, and the doc_ids less
the block's first. Of each, the low bits are packed side by side and the high bits stand in unary in a bitmap, about
2 + log2(range / documents) bits a document. A directory of the place of every ``STEP``-th set bit makes select, and so the
lookup of one document, a short scan. Blocks are bounded by documents and by ids, except that one longer document is a block of
its own. They are stored as binary columns of a Parquet table, so that any store Spark can reach can hold them.

Null texts are empty: only the end id. A null doc_id sorts first. Repeated doc_ids keep all their rows, ordered by their texts.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import chain, compress

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import kept_in_worker, parted, tune, written
from tidemark.llm.words import chunks

VOCABULARY = "word_bpe_49k.json"
CACHE = 650_000
BLOCK_DOCS, BLOCK_IDS, STEP = 4096, 1 << 20, 256
_BAR = "|"
# Fixed value: the vocabulary's own split of a normalised text.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# The same of lower-cased ASCII; `re` is faster, but its \s would also take the four controls that the vocabulary keeps.
_SPLIT_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t\n\r\f\va-z0-9]+")
# Byte-level alphabet by its rule: visible Latin-1 characters stand for themselves, all other bytes follow from U+0100 on.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}
_BITS = np.array([bin(i).count("1") for i in range(256)])


def ef_encode(values: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """Low-bit width, low bits, high bitmap, and the places of every STEP-th set bit, of a non-decreasing sequence from 0 on."""
    n, top = len(values), int(values[-1]) if len(values) else 0
    width = max(0, (max(top, 1) // max(n, 1)).bit_length() - 1)
    low = ((values[:, None] >> np.arange(width)) & 1).astype(np.uint8)
    high = np.zeros((top >> width) + n + 1, dtype=np.uint8)
    ones = (values >> width) + np.arange(n)
    high[ones] = 1
    return width, np.packbits(low.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::STEP].astype("<u4").tobytes()


def ef_all(n: int, width: int, low: bytes, high: bytes) -> np.ndarray:
    """All n values: the place of the i-th set bit, less i, joined to the i-th low bits."""
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(high, np.uint8), bitorder="little"))[:n]
    value = (ones - np.arange(n)) << width
    if width and n:
        bits = np.unpackbits(np.frombuffer(low, np.uint8), bitorder="little", count=n * width).reshape(n, width)
        value = value + bits.astype(np.int64) @ (1 << np.arange(width))
    return value


def ef_select(i: int, width: int, low: bytes, high: bytes, marks: bytes) -> int:
    """The i-th value alone: from the nearest mark before it, a scan over bytes of the bitmap, and width bits of the low part."""
    at, left = int(np.frombuffer(marks, "<u4")[i // STEP]), i % STEP
    byte, size = at >> 3, 64
    while True:
        scan = np.frombuffer(high, np.uint8, min(size, len(high) - byte), byte).copy()
        scan[0] &= 0xFF << (at & 7) & 0xFF
        count = np.cumsum(_BITS[scan])
        if count[-1] > left:
            break
        size *= 2
    k = int(np.searchsorted(count, left, "right"))
    ones = np.flatnonzero(np.unpackbits(scan[k : k + 1], bitorder="little"))
    place = (byte + k << 3) + int(ones[left - (int(count[k - 1]) if k else 0)])
    first = i * width >> 3
    bits = int.from_bytes(low[first : ((i + 1) * width + 7) >> 3], "little") >> (i * width & 7)
    return place - i << width | bits & (1 << width) - 1


class Words:
    """Packed ids by white-space separated word: no token and no normalisation of this vocabulary reaches across a space.

    Words of characters below U+0130 are lower-cased and split here as the vocabulary does; the library's model then encodes
    the pieces, many at a time, with no other step, and pieces are told apart by the end-of-word mark of their last token. Other
    words go through the whole tokenizer, many at a time, parted by a mark that is a token of its own. A piece is itself a word of
    one piece, so both are held together, in two generations of about CACHE each."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.ids: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer.from_file(path)
        self.model.normalizer = normalizers.Sequence([])
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.bar = self.tokenizer.encode(_BAR, add_special_tokens=False).ids[0]
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        size = max(vocabulary.values()) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.ends = np.zeros(size, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def encode_pieces(self, wanted: list[str]) -> None:
        """Pieces as the vocabulary splits them: bytes become letters of its alphabet, and the model does the rest."""
        plain = [x if x.isascii() and x.isprintable() else x.encode().decode("latin-1").translate(_LETTERS) for x in wanted]
        at, size = 0, self.dtype.itemsize
        for e in self.model.encode_batch_fast([" ".join(plain[i : i + 64]) for i in range(0, len(plain), 64)], add_special_tokens=False):
            ids = np.array(e.ids, dtype=self.dtype)
            cut, raw, a = ((np.flatnonzero(self.ends[ids]) + 1) * size).tolist(), ids.tobytes(), 0
            for x, b in zip(wanted[at : at + 64], cut, strict=True):
                self.ids[x] = raw[a:b]
                a = b
            at += 64

    def encode_whole(self, wanted: list[str]) -> None:
        alone = {x for x in wanted if _BAR in x}
        for x in alone:
            self.ids[x] = self.encode(x)
        wanted = [x for x in wanted if x not in alone]
        groups, size = [wanted[i : i + 64] for i in range(0, len(wanted), 64)], self.dtype.itemsize
        for some, e in zip(groups, self.tokenizer.encode_batch_fast([f" {_BAR} ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype=self.dtype)
            cut, raw = np.flatnonzero(ids == self.bar).tolist(), ids.tobytes()
            for x, a, b in zip(some, [0, *[c + 1 for c in cut]], [*cut, len(ids)], strict=True):
                self.ids[x] = raw[size * a : size * b]

    def learn(self, new: set[str]) -> None:
        """Words that aren't among the ids yet."""
        ids, older = self.ids, self.older

        def lacking(wanted):
            known = {x: older[x] for x in wanted if x in older} if older else {}
            ids.update(known)
            return wanted.difference(known)

        new = lacking(new)
        whole = [w for w in new if not w.isascii() and max(w) >= "\u0130"]
        some = list(new.difference(whole))
        low = list(map(str.lower, some))
        single = list(map(str.isalpha, low))
        several = [(w, (_SPLIT_ASCII if x.isascii() else _SPLIT).findall(x)) for w, x, alone in zip(some, low, single, strict=True) if not alone]
        single = list(compress(zip(some, low, strict=True), single))
        wanted = {x for _, x in single}.union(chain.from_iterable(found for _, found in several)).difference(ids)
        self.encode_pieces(list(lacking(wanted)))
        for w, x in single:
            if w != x:
                ids[w] = ids[x]
        for w, found in several:
            ids[w] = b"".join([ids[x] for x in found])
        self.encode_whole(whole)

    def documents(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Of about a MB of texts, or of one longer text; a null is empty."""
        if len(self.ids) >= CACHE:
            self.ids, self.older = {}, self.ids
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        texts = texts.fill_null("")
        # texts that spell a special token go through the tokenizer as they are
        special = np.zeros(len(texts), dtype=bool)
        for token in self.special:
            special |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(special), "", texts) if special.any() else texts
        # parted at the six ASCII spaces alone: str.split() also parts at four controls that the vocabulary keeps
        found = pc.ascii_split_whitespace(plain)
        # each different word of the texts is looked up once; those that weren't there are filled in
        coded = found.flatten().dictionary_encode()
        names, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        got = list(map(self.ids.get, names))
        lacking = [i for i, x in enumerate(got) if x is None]
        self.learn({names[i] for i in lacking})
        for i in lacking:
            got[i] = self.ids[names[i]]
        size, pool = self.dtype.itemsize, np.frombuffer(b"".join(got), self.dtype)
        length = np.fromiter(map(len, got), np.int64, len(got)) // size
        first, length = (np.cumsum(length) - length)[at], length[at]
        ends = np.concatenate([[0], np.cumsum(length)])
        ids = pool[np.arange(ends[-1]) + np.repeat(first - ends[:-1], length)].tobytes()
        words = found.offsets.to_numpy()
        cuts = (ends[words - words[0]] * size).tolist()
        return [self.encode(texts[i].as_py()) if alone else ids[x:y] for i, (alone, x, y) in enumerate(zip(special.tolist(), cuts, cuts[1:], strict=False))]


@kept_in_worker
def words(path: str) -> Words:
    return Words(path)


_BLOCK = "shard int, block int, inside long, n_docs int, n_ids long, item int, ids binary, width int, low binary, high binary, marks binary, n_null int, first_id long, last_id long, id_width int, id_low binary, id_high binary, id_marks binary"
_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
_ARROW = pa.schema([(name, _TYPES[kind]) for name, kind in (c.split() for c in _BLOCK.split(", "))])


def _blocks(path: str, end_id: int):
    """Blocks of a task's documents; inside counts the ids of the task's earlier blocks, so no later pass has to."""

    def pack(shard, block, inside, docs, held, dtype):
        lengths = np.array([len(x) // dtype.itemsize for x in held], dtype=np.int64)
        width, low, high, marks = ef_encode(np.cumsum(lengths))
        known = np.array([d for d in docs if d is not None], dtype=np.int64)
        first = int(known[0]) if len(known) else 0
        id_width, id_low, id_high, id_marks = ef_encode(known - first)
        row = [shard, block, inside, len(docs), int(lengths.sum()), dtype.itemsize, b"".join(held), width, low, high, marks, len(docs) - len(known), first, int(known[-1]) if len(known) else None, id_width, id_low, id_high, id_marks]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _ARROW, strict=True)], schema=_ARROW)

    def run(batches):
        w = words(path)
        # an end id that the packed ids can't hold widens them all
        dtype = w.dtype if end_id < 1 << 8 * w.dtype.itemsize else np.dtype("<u4")
        tail = np.array([end_id], dtype=dtype).tobytes()
        shard, block, docs, held, size, inside = TaskContext.get().partitionId(), 0, [], [], 0, 0
        for batch in batches:
            encoded = (x for a, b, _, _ in chunks(batch.column(1)) for x in w.documents(batch.column(1)[a:b]))
            for d, ids in zip(batch.column(0).to_pylist(), encoded, strict=True):
                if dtype != w.dtype:
                    ids = np.frombuffer(ids, w.dtype).astype(dtype).tobytes()
                ids += tail
                if docs and (len(docs) >= BLOCK_DOCS or size + len(ids) > dtype.itemsize * BLOCK_IDS):
                    yield pack(shard, block, inside, docs, held, dtype)
                    inside += size // dtype.itemsize
                    block, docs, held, size = block + 1, [], [], 0
                docs.append(d)
                held.append(ids)
                size += len(ids)
        if docs:
            yield pack(shard, block, inside, docs, held, dtype)

    return run


def encode(documents: DataFrame, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Blocks of the ids of all documents (doc_id, text), ready to be written; shards are ranges of doc_id."""
    spark = documents.sparkSession
    tune(spark)
    n = parted(spark)
    placed = documents.select("doc_id", "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first())
    placed = placed.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return placed.mapInArrow(_blocks(path or public_tokenizers.path(VOCABULARY), end_id), _BLOCK)


def offsets(blocks: DataFrame) -> DataFrame:
    """blocks with base: the ids of all blocks before it. One number a shard is summed and broadcast; shards are as many as
    shuffle partitions. The ids themselves aren't moved."""
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return blocks.join(F.broadcast(shards.select("shard", before.alias("before"))), "shard").withColumn("base", F.col("before") + F.col("inside"))


def _read(batches):
    for batch in batches:
        for r in batch.to_pylist():
            ends = ef_all(r["n_docs"], r["width"], r["low"], r["high"])
            known = ef_all(r["n_docs"] - r["n_null"], r["id_width"], r["id_low"], r["id_high"]) + r["first_id"]
            ids = memoryview(np.frombuffer(r["ids"], dtype=f"<u{r['item']}").astype("<u4")).cast("B")
            starts = np.concatenate([[0], ends[:-1]])
            crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            doc = pa.concat_arrays([pa.nulls(r["n_null"], pa.int64()), pa.array(known, pa.int64())])
            yield pa.RecordBatch.from_arrays([doc, pa.array(starts + r["base"]), pa.array(ends - starts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def digest(documents: DataFrame, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Writes the files to the shared folder, reads them back: doc_id, start, n_tokens, ids_crc32."""
    stored = written(encode(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), end_id, path), "tokens")
    some = offsets(stored).select("base", "n_docs", "item", "ids", "width", "low", "high", "n_null", "first_id", "id_width", "id_low", "id_high")
    return some.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(blocks: DataFrame, doc_id: int) -> DataFrame:
    """The ids (array<int>) of a document: one row for each of its rows. Blocks are skipped by their range of doc_ids; inside a
    block its place is found by bisection over select, and only its own ids are unpacked."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                n, key = r["n_docs"] - r["n_null"], [r["id_width"], r["id_low"], r["id_high"], r["id_marks"]]
                lo, hi = 0, n
                while lo < hi:
                    mid = (lo + hi) // 2
                    lo, hi = (mid + 1, hi) if ef_select(mid, *key) + r["first_id"] < doc_id else (lo, mid)
                ends = [r["width"], r["low"], r["high"], r["marks"]]
                while lo < n and ef_select(lo, *key) + r["first_id"] == doc_id:
                    i = lo + r["n_null"]
                    a, b = ef_select(i - 1, *ends) if i else 0, ef_select(i, *ends)
                    ids = np.frombuffer(r["ids"], f"<u{r['item']}", b - a, a * r["item"]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int32()))], ["ids"])
                    lo += 1

    return blocks.where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).mapInArrow(run, "ids array<int>")

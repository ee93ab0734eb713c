"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Every match of the split pattern is encoded alone: a piece that is itself in the vocabulary is one id; otherwise its bytes
form a linked list, and each adjacent pair whose joined bytes have a rank waits in that rank's bucket. A two-level bitmap
over ranks marks the buckets in use; find-first-set gives the lowest rank, its positions are merged from left to right, and
entries whose pair has changed meanwhile are skipped. The cost is near-linear in the bytes, so pieces of millions of bytes are no
problem. Pieces not seen lately share one queue: their lists lie side by side, with no pair across, so the bitmap is walked once
for ``BATCH`` of them.

Pieces repeat, so each Python worker keeps the ids of recent ones in two generations of at most ``CACHE`` each.
Null texts are empty: no ids, the digests of the empty string. Rows are independent: ties and repeated rows need no rule, and null
ids are passed on.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import accumulate, chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.shared import kept_in_worker, with_field

CACHE = 300_000
BATCH = 256
LONG_PIECE = 4096
LONG_TEXT = 1 << 20
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class RankQueue:
    """A bitmap of two levels over the ranks: top marks the groups of 256 ranks in use, low the ranks of each group."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        size = max(ranks.values()) + 1
        self.byte = np.array([ranks[bytes([i])] for i in range(256)])
        # rank of each pair of ids whose joined bytes are a token, by its left id and by its right one; ids are ranks
        none: dict[int, int] = {}
        self.right, self.left = [none] * size, [none] * size
        #: the same of two bytes, at 256 times the first and the second; -1: none
        self.first = np.full(1 << 16, -1)
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                x, y = ranks.get(token[:i]), ranks.get(token[i:])
                if x is not None and y is not None:
                    for table, a, b in ((self.right, x, y), (self.left, y, x)):
                        if table[a] is none:
                            table[a] = {}
                        table[a][b] = rank
            if len(token) == 2:
                self.first[token[0] << 8 | token[1]] = rank
        #: one number object for each id, shared by all pieces that are kept
        self.number = list(range(size))
        self.low = [0] * ((size - 1 >> 8) + 1)
        self.bit = [1 << i for i in range(max(256, len(self.low)))]

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece. Between calls every bitmap word is zero again."""
        left, right, low, bit, top = self.left, self.right, self.low, self.bit, 0
        raw = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        n = len(raw)
        ids: list[int | None] = self.byte[raw].tolist()
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        first = np.append(self.first[raw[:-1] << 8 | raw[1:]], -1) if n else raw
        ends = list(accumulate(map(len, pieces)))
        for end in ends:
            # n stands for the end of every piece, -1 for what is before one
            if 0 < end:
                after[end - 1] = n
                first[end - 1] = -1
            if end < n:
                before[end] = -1
        waiting: list[int | None] = first.tolist()
        order = np.argsort(first, kind="stable")[np.count_nonzero(first < 0) :]
        starts = np.flatnonzero(np.diff(first[order], prepend=-1))
        ranked, held, cuts = first[order[starts]].tolist(), order.tolist(), [*starts.tolist(), n]
        buckets = {rank: held[a:b] for rank, a, b in zip(ranked, cuts, cuts[1:])}
        for rank in buckets:
            low[rank >> 8] |= bit[rank & 255]
            top |= bit[rank >> 8]
        while top:
            group = (top & -top).bit_length() - 1
            word = low[group]
            rank = group << 8 | (word & -word).bit_length() - 1
            low[group] = word = word & word - 1
            if not word:
                top &= top - 1
            bucket = buckets.pop(rank)
            if len(bucket) > 1:
                bucket.sort()
            to_right, to_left = right[rank].get, left[rank].get
            for at, i in enumerate(bucket):
                if waiting[i] != rank:
                    continue
                lower = False
                j = after[i]
                after[i] = stop = after[j]
                waiting[j] = waiting[i] = ids[j] = None
                ids[i] = rank
                if stop < n:
                    before[stop] = i
                    new = to_right(ids[stop])
                    if new is not None:
                        waiting[i] = new
                        lower = new < rank
                        if new in buckets:
                            buckets[new].append(i)
                        else:
                            buckets[new] = [i]
                            low[new >> 8] |= bit[new & 255]
                            top |= bit[new >> 8]
                i = before[i]
                if i >= 0:
                    waiting[i] = new = to_left(ids[i])
                    if new is not None:
                        lower = lower or new < rank
                        if new in buckets:
                            buckets[new].append(i)
                        else:
                            buckets[new] = [i]
                            low[new >> 8] |= bit[new & 255]
                            top |= bit[new >> 8]
                if lower and at + 1 < len(bucket):
                    # a pair of lower rank comes first; the rest of this bucket waits
                    buckets[rank] = bucket[at + 1 :]
                    low[rank >> 8] |= bit[rank & 255]
                    top |= bit[rank >> 8]
                    break
        number = self.number
        return [[number[x] for x in ids[a:b] if x is not None] for a, b in zip([0, *ends], ends)]


class Pieces(dict):
    """Ids by piece; two generations, so at most 2 * CACHE pieces and those of one block of text are held."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.ranks = ranks
        self.queue = RankQueue(ranks)
        self.older: dict[str, tuple[int, ...]] = {}

    def learn(self, found: set[str]) -> None:
        """Takes in pieces that aren't among the recent ones, all in one queue. Very long ones are encoded when they are asked for, and not kept."""
        if len(self) >= CACHE:
            self.older = dict(self)
            self.clear()
        older, ranks, names, raws = self.older, self.ranks, [], []
        for piece in found:
            ids = older.get(piece)
            if ids is None:
                raw = piece.encode()
                rank = ranks.get(raw)
                if rank is None:
                    if len(raw) <= LONG_PIECE:
                        names.append(piece)
                        raws.append(raw)
                    continue
                ids = (rank,)
            self[piece] = ids
        # some hundred at a time: what the queue works on stays in the processor's cache
        for i in range(0, len(raws), BATCH):
            self.update(zip(names[i : i + BATCH], map(tuple, self.queue.merge(raws[i : i + BATCH])), strict=True))

    def __missing__(self, piece: str) -> list[int]:
        raw = piece.encode()
        rank = self.ranks.get(raw)
        return [rank] if rank is not None else self.queue.merge([raw])[0]


class Codec:
    def __init__(self, path: str, pattern: str) -> None:
        ranks = read_ranks(path)
        self.pieces = Pieces(ranks)
        self.pattern = regex.compile(pattern)
        size = max(ranks.values()) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.decimal = [str(i) for i in range(size)]

    def blocks(self, texts: list[str]):
        """(place of the text, ids in it), in order. A long text is never held as one list; short ones are learnt from together."""
        held, size = [], 0
        for place, text in enumerate(texts):
            if len(text) > LONG_TEXT:
                yield from self._known(held)
                held, size = [], 0
                matches = self.pattern.finditer(text)
                while block := [m.group() for m in islice(matches, 100_000)]:
                    yield from self._known([(place, block)])
                continue
            held.append((place, self.pattern.findall(text)))
            size += len(text)
            if size >= LONG_TEXT:
                yield from self._known(held)
                held, size = [], 0
        yield from self._known(held)

    def _known(self, held: list[tuple[int, list[str]]]):
        # each piece is looked up once; those that weren't there are filled in
        flat = list(chain.from_iterable(found for _, found in held))
        got = list(map(self.pieces.get, flat))
        lacking = [i for i, x in enumerate(got) if x is None]
        self.pieces.learn({flat[i] for i in lacking})
        for i in lacking:
            got[i] = self.pieces[flat[i]]
        at = 0
        for place, found in held:
            yield place, list(chain.from_iterable(got[at : at + len(found)]))
            at += len(found)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(ids for _, ids in self.blocks([text])))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@kept_in_worker
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """df with a column of token ids (array<int>) of each text; an existing column of that name is replaced."""
    path, pattern = path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN
    kept = [c for c in df.columns if c.lower() != out.lower()]

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            ids = pa.array([c.encode(x or "") for x in table[text].to_pylist()], pa.list_(pa.int32()))
            yield from table.append_column(out, ids).to_batches()

    base = df.select(*[f"`{c}`" for c in kept])
    return base.mapInArrow(run, with_field(base, out, "array<int>"))


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """df with the bytes (binary) that each array of ids stands for; null ids give null."""
    path = path or public_tokenizers.path(VOCABULARY)
    kept = [c for c in df.columns if c.lower() != out.lower()]

    def run(batches):
        c = codec(path, public_tokenizers.PATTERN)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            raw = pa.array([None if x is None else c.decode(x) for x in table[ids].to_pylist()], pa.binary())
            yield from table.append_column(out, raw).to_batches()

    base = df.select(*[f"`{c}`" for c in kept])
    return base.mapInArrow(run, with_field(base, out, "binary"))


def digest(documents: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the bytes decoded from them; ids themselves stay in the task."""
    path, pattern = path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            counts = [0] * len(texts)
            of_ids, of_bytes = [hashlib.sha256() for _ in texts], [hashlib.sha256() for _ in texts]
            for place, ids in c.blocks(texts):
                if ids:
                    comma = "," if counts[place] else ""
                    counts[place] += len(ids)
                    of_ids[place].update((comma + ",".join(map(c.decimal.__getitem__, ids))).encode())
                    of_bytes[place].update(c.decode(ids))
            of_ids, of_bytes = [x.hexdigest() for x in of_ids], [x.hexdigest() for x in of_bytes]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_bytes)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

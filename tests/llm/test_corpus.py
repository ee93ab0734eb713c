"""Corpus operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, jaccard, mixing, neardup, nearest, repeats, secrets, tokenfile, toxicity, words
from tidemark.llm.shared import components, forest

WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    base = [prose(rng, n) for n in (120, 90, 60, 200, 33)]
    passage = prose(rng, 70)
    out = [None, "", " \t\n", "one two", "one two", "ONE\x0btwo", "a b c d e", "A B c D e f"]
    out += base + base[:2]
    for b in base[:3]:
        w = b.split()
        for k in (1, 3, 6, 12):
            v = list(w)
            for i in rng.sample(range(len(v)), k):
                v[i] = "x" + str(rng.random())
            out.append(" ".join(v))
    out += [prose(rng, 20) + " " + passage + " " + prose(rng, 30) for _ in range(6)]
    out += [passage, passage + " é 　 ñ", " ".join(["same"] * 130), " ".join(["same"] * 60), "long " * 30000]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3 + 1, t, "en", None if i % 7 == 0 else f"s{i % 3}", "clash", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, ids string, score long")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def split(t, lower=False):
    b = (t or "").encode()
    return (b.lower() if lower else b).split()


def shingles(t):
    w = split(t, True)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_word_hashes_agree_with_sets(texts):
    for t, s in zip(texts, words.shingle_sets(pa.array(texts)), strict=True):
        assert len(s) == len(shingles(t))


def test_forest_and_components(spark):
    a, b = forest(np.array([5, 4, 9, 7]), np.array([4, 2, 8, 7]))
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == {5: 2, 4: 2, 9: 8}
    chain = [(i, i + 1) for i in range(40)] + [(100, 99), (50, 50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 99, 99: 99}


def test_ngram_jaccard(docs, empty, texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(docs).collect()}
    assert got == {i * 3 + 1: (len(s), find(i) * 3 + 1) for i, s in enumerate(sets)}
    assert jaccard.classes(empty).count() == 0


def test_jaccard_null_and_repeated_ids(spark):
    """Rows with a null id stay and link with nothing; rows of one id are one document of the graph, each with its own set."""
    rng = random.Random(1)
    x, y, z = prose(rng, 40), prose(rng, 40), prose(rng, 30)
    rows = [(None, x), (2, x), (7, x + " end"), (7, y), (9, y + " end"), (9, y + " end"), (11, z), (12, None), (None, None), (13, "A b"), (14, "a\tB")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 36, None), (2, 36, 2), (7, 37, 2), (7, 36, 2), (9, 37, 2), (9, 37, 2), (11, 26, 11), (12, 0, 12), (None, 0, None), (13, 1, 13), (14, 1, 13)], key=str)


@pytest.mark.parametrize(("common", "group"), [(2, 400), (48, 300_000)])
def test_jaccard_on_texts_of_common_lines(spark, monkeypatch, common, group):
    """Short texts put together from few lines, with changed words: empty, dear and deleted segments all matter."""
    monkeypatch.setattr(jaccard, "COMMON", common)
    monkeypatch.setattr(jaccard, "GROUP", group)
    rng = random.Random(common)
    lines = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(6)) for _ in range(rng.randrange(4, 14))) for _ in range(12)]
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(9))) for _ in range(60)]
    for _ in range(200):
        w = " ".join(rng.choice(lines) for _ in range(rng.randrange(1, 7))).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            w[rng.randrange(len(w))] = f"q{rng.randrange(1000)}" if rng.random() < 0.7 else ""
        texts.append(" ".join(w))
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    got = {r.doc_id: r.component_id for r in jaccard.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(root))


def test_jaccard_links_are_exact():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 60, 200).astype(np.uint64)
    sets = []
    for _ in range(150):
        s = base.copy()
        k = rng.integers(0, 60)
        s[rng.choice(200, k, replace=False)] = rng.integers(0, 1 << 60, k).astype(np.uint64)
        sets.append(np.unique(s[: rng.integers(100, 200)]))
    a, b = jaccard.linked(sets)
    want = {(i, j) for j in range(150) for i in range(j) if 100 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 75 * (len(sets[i]) + len(sets[j]) - c)}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want


def test_parity_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(8)
    kept = 0
    for _ in range(400):
        n, m = int(rng.integers(1, 600)), int(rng.integers(0, 200))
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate([a[: n - int(rng.integers(0, n // 3 + 1))], rng.integers(0, 1 << 63, m, dtype=np.uint64)])
        apart = len(np.setxor1d(a, b))
        gap = jaccard.differing(jaccard.parity(a), jaccard.parity(b))
        assert gap <= apart and gap == jaccard.differing(jaccard.parity(b), jaccard.parity(a))
        kept += apart > (len(a) + len(b)) // 7 >= gap
    assert jaccard.differing(jaccard.parity(np.empty(0, np.uint64)), jaccard.parity(np.empty(0, np.uint64))) == 0
    assert kept < 60  # most pairs that aren't linked go


def test_jaccard_common_segments(spark, monkeypatch):
    """One dense group of near copies and one passage in unrelated texts, with a small bound for common segments."""
    monkeypatch.setattr(jaccard, "COMMON", 4)
    monkeypatch.setattr(jaccard, "GROUP", 3000)
    rng = random.Random(9)
    base, passage = prose(rng, 100).split(), prose(rng, 25)
    texts = []
    for k in range(60):
        v = list(base)
        for i in rng.sample(range(100), k % 9):
            v[i] = f"z{rng.random()}"
        texts.append(" ".join(v))
    texts += [prose(rng, 30) + " " + passage + " " + prose(rng, 10) for _ in range(40)]
    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    got = {r.doc_id: r.component_id for r in jaccard.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(root))


def test_substring_dedup(docs, empty, texts):
    first, gone = {}, {}
    for i, t in enumerate(texts):
        w = split(t)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, t in enumerate(texts):
        w = split(t)
        marks = {p for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for p in range(k, k + 50)}
        kept = [x for p, x in enumerate(w) if p not in marks]
        gone[i * 3 + 1] = (len(w), len(marks), hashlib.sha256(b" ".join(kept)).hexdigest())
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeats.digest(docs).collect()} == gone
    assert repeats.digest(empty).count() == 0
    texts_kept = {r.doc_id: r.kept_text for r in repeats.removed(docs).collect()}
    assert texts_kept[1] is None and all(v is None or hashlib.sha256(v.encode()).hexdigest() == gone[k][2] for k, v in texts_kept.items())


def test_substring_dedup_null_and_repeated_ids(spark):
    """Each row is judged by itself, against documents of smaller ids only; rows are neither lost nor multiplied."""
    rng = random.Random(2)
    x, y, z = prose(rng, 90), prose(rng, 80), prose(rng, 60)
    rows = [(1, x), (2, y), (5, x), (5, y), (5, "short"), (6, z + " end"), (6, z), (6, z), (None, x), (None, None), (7, "q " * 30 + z), (8, "deep " * 300_000)]
    got = [(r.doc_id, r.n_words, r.n_removed) for r in repeats.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    want = [(1, 90, 0), (2, 80, 0), (5, 90, 90), (5, 80, 80), (5, 1, 0), (6, 61, 0), (6, 60, 0), (6, 60, 0), (None, 90, 0), (None, 0, 0), (7, 90, 60), (8, 300_000, 0)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_bpe_equals_the_library(docs, empty, texts):
    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path(bpe.VOCABULARY)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    c = bpe.codec(path, public_tokenizers.PATTERN)
    rng = random.Random(3)
    for k in range(200):
        s = "".join(rng.choice("aab é\nAß1 中ni'st") for _ in range(rng.randint(0, 200)))
        s = s.replace(" ", "") if k % 2 else s
        assert c.encode(s) == library.encode_ordinary(s) and c.decode(c.encode(s)) == s.encode()
    assert c.encode("ab" * 50000) == library.encode_ordinary("ab" * 50000)
    want = {}
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        want[i * 3 + 1] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digest(docs).collect()} == want
    both = bpe.decode(bpe.encode(docs))
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in both.collect()) and "score" in both.columns
    assert bpe.digest(empty).count() == 0


def test_pieces_that_come_again_are_not_merged_again(monkeypatch):
    c = bpe.Codec(public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)
    merged, merge = [], c.pieces.queue.merge
    monkeypatch.setattr(c.pieces.queue, "merge", lambda raws: merged.extend(raws) or merge(raws))
    words = [" zq" + "".join(chr(97 + i // 26**k % 26) for k in range(4)) + "qz" for i in range(250_000)]
    texts = ["".join(words[i : i + 50_000]) for i in range(0, len(words), 50_000)]
    ids = [c.encode(x) for x in texts]
    assert [c.encode(x) for x in texts] == ids and "".join(texts).encode() == c.decode([i for some in ids for i in some])
    assert len(merged) == len(set(merged))
    assert c.pieces.queue.merge([]) == [] and c.pieces.queue.merge([b"", b"a", b""]) == [[], [c.pieces.ranks[b"a"]], []]


def test_token_file(docs, empty, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(tokenfile.VOCABULARY))
    start, want = 0, {}
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want[i * 3 + 1] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokenfile.digest(docs).collect()} == want
    assert tokenfile.digest(empty).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n in (1, 2, 100, 4096):
        for most in (2, 3000, 1 << 40):
            ends = np.cumsum(rng.integers(0, most, n)) * (1 if most < 1 << 40 else rng.integers(0, 2))
            width, low, high, marks = tokenfile.ef_encode(ends)
            assert (tokenfile.ef_all(n, width, low, high) == ends).all()
            assert [tokenfile.ef_select(i, width, low, high, marks) for i in range(0, n, max(1, n // 50))] == ends[:: max(1, n // 50)].tolist()
            assert len(low) + len(high) + len(marks) <= n * (2 + max(0, int(ends[-1]) // n).bit_length()) // 8 + n // 4 + 16
    # far apart: a scan over many bytes
    far = np.array([0] * 300 + [1 << 20])
    assert tokenfile.ef_select(300, *tokenfile.ef_encode(far)) == 1 << 20


def test_token_file_words_equal_the_library():
    """Fuzz: every word alone and in context, with marks, contractions, digits, controls, accents and letters beyond U+0130."""
    rng = random.Random(8)
    parts = ["don't", "'s", "'S", "rock'n'roll", "x's't", "\u00e9", "\u00c9T\u00c9", "\u00b2", "\u00bd", "\u00aa", "\u00df", "_", "a_b", "...", ".,", "12", "3.14", "\x00", "\x7f", "\xad", "|", "a|b", "\u0130", "\u03a3", "\u6f22", "e\u0301", "\u0301", "AbC", "\U0001f600", "\u00a0", "\x85", "\x1c", "<|endoftext|>", "<|", "(", "-", "\"", "'", "''", "ll"]
    seps = [" ", "  ", "\n", "\t", "", "", "", "\r\n", "\x0b", "\x1d", "\u3000"]
    texts = ["".join(rng.choice(parts) + rng.choice(seps) for _ in range(rng.randrange(1, 12))) for _ in range(4000)]
    w = tokenfile.Words(public_tokenizers.path(tokenfile.VOCABULARY))
    for lo in range(0, len(texts), 500):
        for x, raw in zip(texts[lo : lo + 500], w.documents(texts[lo : lo + 500]), strict=True):
            assert np.frombuffer(raw, w.dtype).tolist() == w.tokenizer.encode(x, add_special_tokens=False).ids, repr(x)


def test_token_words_and_pieces_are_held_once(monkeypatch):
    """ASCII words are split as all others are, and what falls out of the first generation is found in the second."""
    rng = random.Random(3)
    some = ["".join(chr(rng.randrange(128)) if rng.random() < 0.5 else rng.choice("'st0re1vmld.\x1c\x1f") for _ in range(rng.randint(1, 9))).lower() for _ in range(20_000)]
    assert all(tokenfile._SPLIT_ASCII.findall(x) == tokenfile._SPLIT.findall(x) for x in some)
    monkeypatch.setattr(tokenfile, "CACHE", 4)
    w = tokenfile.Words(public_tokenizers.path(tokenfile.VOCABULARY))
    for x in ("Abc abc. a1 don't", "abc zzq zzr", "Abc. b2 zzq", "abc don't zzr a1", "Abc abc."):
        assert np.frombuffer(w.documents([x])[0], w.dtype).tolist() == w.tokenizer.encode(x, add_special_tokens=False).ids
    assert not hasattr(w, "pieces")


def test_token_file_null_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK_DOCS", 3)
    rows = [(None, "b"), (None, None), (5, "a a"), (5, "a a"), (5, "one"), (-9, ""), (1 << 61, "two words"), (7, "x " * 400)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.start, r.n_tokens) for r in tokenfile.digest(d).collect()), key=lambda r: r[1])
    assert [(i, n) for i, _, n in got] == [(None, 1), (None, 2), (-9, 1), (5, 3), (5, 3), (5, 2), (7, 401), (1 << 61, 3)]
    assert [s for _, s, _ in got] == [sum(n for _, _, n in got[:i]) for i in range(len(got))]
    stored = tokenfile.encode(d)
    assert sorted(len(r.ids) for r in tokenfile.lookup(stored, 5).collect()) == [2, 3, 3] and tokenfile.lookup(stored, 6).count() == 0
    # an end id beyond 16 bits widens the ids
    wide = {r.doc_id: r.n_tokens for r in tokenfile.digest(d.where("doc_id = 7"), end_id=70_000).collect()}
    assert wide == {7: 401} and tokenfile.lookup(tokenfile.encode(d, end_id=70_000), 7).first().ids[-1] == 70_000


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(6, 16))
    x = np.concatenate([c + rng.normal(size=(k, 16)) * 0.06 for c, k in zip(centre, (40, 5, 3, 2, 1, 1), strict=True)] + [rng.normal(size=(60, 16))])
    rows = [(i * 5, [float(v) for v in r], 1, "extra") for i, r in enumerate(x)]
    bad = [(9001, None, 0, ""), (9005, [0.0] * 16, 0, ""), (9010, [float("nan")] * 16, 0, ""), (9015, [None] * 16, 0, ""), (9020, [float("inf")] * 16, 0, ""), (9025, [], 0, ""), (None, rows[0][1], 0, "")]
    df = spark.createDataFrame(rows + rows[:2] + bad, "vec_id long, embedding array<double>, n_links int, id string")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    g = u @ u.T
    np.fill_diagonal(g, -2)
    got = {r.vec_id: r for r in neardup.near_duplicates(df).collect()}
    assert len(got) == len(rows) + len(bad)
    assert [got[i * 5].n_links for i in range(len(x))] == (g >= 0.9).sum(1).tolist()
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (9001, 9005, 9010, 9015, 9020, 9025)) and got[None].n_links == 0
    assert neardup.near_duplicates(df.limit(0)).count() == 0
    found = {}
    for r in nearest.nearest(df, "id % 50 = 0").collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == {i * 5 for i in range(0, len(x), 10)}
    hits = 0
    for q, rs in found.items():
        rs.sort()
        row = g[q // 5]
        best = np.lexsort((np.arange(len(x)), -row))[:5] * 5
        assert [r for r, _, _ in rs] == [1, 2, 3, 4, 5] and all(abs(row[v // 5] - s) < 1e-12 for _, v, s in rs)
        hits += len(set(best.tolist()) & {v for _, v, _ in rs})
    assert hits >= 0.9 * 5 * len(found)
    assert nearest.nearest(df.limit(0), "id % 50 = 0").count() == 0


def test_windows_reach_over_partitions(spark):
    """One pass whose window holds all rows meets every pair, however many partitions the rows are dealt over."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 16))
    x = np.concatenate([x, 0.9 * x + 0.35 * rng.normal(size=x.shape)])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    g = u @ u.T
    np.fill_diagonal(g, -2)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        got = {r.vec_id: r.n_links for r in neardup.near_duplicates(df, passes=1, window=300).collect()}
        some = {r.vec_id: r.n_links for r in neardup.near_duplicates(df, window=48).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = (g >= 0.9).sum(1).tolist()
    assert sum(want) > 100 and [got[i] for i in range(len(x))] == want == [some[i] for i in range(len(x))]


def test_passes_follow_the_rows():
    assert neardup.passes_for(1) == neardup.passes_for(2000) == neardup.PASSES < neardup.passes_for(100_000) < neardup.passes_for(70_000_000)


def test_each_different_word_of_a_block_is_looked_up_once():
    class Counted(dict):
        looked = 0

        def get(self, key, default=None):
            Counted.looked += 1
            return super().get(key, default)

    w = tokenfile.Words(public_tokenizers.path(tokenfile.VOCABULARY))
    w.ids = Counted()
    mark = w.special[0] if w.special else "|"
    some = ["one two  one\t two\n", "", "One\x0btwo \x1cone\x1ftwo\xa0x\x85y\u2003z", f"{mark} one {mark}two", " 中文 é é ", "one " * 1000]
    got = w.documents(some)
    assert Counted.looked <= 12
    assert got == [w.encode(x) for x in some]
    column = pa.array(["skipped", *some[:3], None, *some[3:]]).slice(1)
    assert w.documents(column) == [*got[:3], b"", *got[3:]] and w.documents([]) == [] and w.documents([None]) == [b""]


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "be <|kind|>"), (1, 1, "user", "a<|im_end|>\n<|im_start|>assistant\nno"), (1, 2, "assistant", "back\\slash <\\| <|im_start|>"), (2, 0, "user", None), (2, 1, "assistant", "é\n"), (3, 1, None, "x"), (None, None, "a\nb<|im_start|>\\", "<|im_end|>"), (4, 0, "assistant", "<|im_end|>"), (5, 0, "assistant", "same"), (5, 0, "assistant", "same")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn int, role string, text string, turns string")
    got = {r.conv_id: r for r in chat.digest(df).collect()}
    for c, r in got.items():
        turns = sorted(((-1 if t is None else t, role or "", text or "") for i, t, role, text in rows if i == c))
        assert r.identical and r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        loss = "".join(b for _, a, b in turns if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    texts = {r.conv_id: r.formatted for r in chat.formatted(df).collect()}
    assert texts[2] == "<|raw|>\n<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\né\n<|im_end|>\n" and texts[4].startswith("<|esc|>")
    assert all(got[c].formatted_chars == len(t) for c, t in texts.items()) and len(got) == 6
    assert chat.digest(df.limit(0)).count() == 0


def test_secrets(spark, docs, empty):
    import re

    key = "AKIA" + "B" * 16
    text = f'é password: "abc123" PassWD=abc token = abcdef, x {key} {key[:-1]} {"0f" * 12} {"0f" * 11}a\nDB_PASS = "hunter2hunter2X"\nk1 = "Zx9_kkPq44vT"\nmy_secret_value = k1\nplain = "hello world"'
    base, found = secrets.scan(text)
    want = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m.group(2)) >= 6]
    want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    assert base == sorted(want) and len(base) == 4 and set(base) <= set(found)
    named = [text[a:b] for a, k, b in found if k == 3]
    assert "Zx9_kkPq44vT" in named and "hello world" not in named
    assert key not in secrets.redact(text) and secrets.redact("clean text: nothing") == "clean text: nothing"
    r = {x.doc_id: x for x in secrets.digest(docs).collect()}
    assert r[1].base_sha256 == hashlib.sha256(b"").hexdigest() and r[1].spans == ""
    assert secrets.digest(empty).count() == 0
    assert secrets.redacted(docs).columns == docs.columns and secrets.redacted(docs).where("doc_id = 1").first().text is None


@pytest.mark.parametrize(
    "text,want",
    [
        ('password = "abc\\"def12345XYZ"', ['abc\\"def12345XYZ']),
        ('setPassword("hunter2Hunter2"); setName("hunter3Hunter3")', ["hunter2Hunter2"]),
        ('{"auth": ["Zx9_kkPq44vT", "Qw8_kkPq44vT"], "user": "bobBob123"}', ["Zx9_kkPq44vT", "Qw8_kkPq44vT"]),
        ("<password>Zx9_kkPq44vT</password><user>Zx9_kkPq44vU</user>", ["Zx9_kkPq44vT"]),
        ('secret = """Zx9_kkPq44vT\nmore"""', ["Zx9_kkPq44vT\nmore"]),
        ("api_key = `Zx9_kkPq44vT`", ["Zx9_kkPq44vT"]),
        ('db_pwd = "part1Aa9" + "part2Bb8zz"\nx = "part3Cc7"', ["part1Aa9", "part2Bb8zz"]),
        ('a = "zz Top8 hello"; a = "zz Top9 hello"; secret_x = a; a = "zz Top7 hello"', ["zz Top9 hello"]),
        ('k1 = "Zx9_kkPq44vT"\nk2 = k1\nmy_secret = k2', ["Zx9_kkPq44vT"]),
        ('part = "Zx9_kkPq44vT"\nsecret = part + "-suffix99A"', ["Zx9_kkPq44vT", "-suffix99A"]),
        ('password: str = "Zx9_kkPq44vT"', ["Zx9_kkPq44vT"]),
        ('client_secret = ("a1B2c3D4"\n  "e5F6g7H8")\nother = "e5F6g7H9"', ["a1B2c3D4", "e5F6g7H8"]),
        ('connect(password="Zx9_kkPq44vT", host="local.Host9")', ["Zx9_kkPq44vT"]),
        ("{'private_key' => 'Zx9_kkPq44vT'}", ["Zx9_kkPq44vT"]),
        ('password = getenv("Zx9_kkPq44vT")', []),
        ("a token (see Section12A, don't read Section13B)\n\n'Section14C' of it", []),
        ("secret:", []),
    ],
)
def test_named_secrets(text, want):
    assert [text[a:b] for a, b in secrets.named(text)] == want


def test_secrets_have_no_length_caps():
    import time

    rng = random.Random(7)
    long = "".join(rng.choice("abcXYZ0189+/") for _ in range(9000))
    wide = " " * 40
    for text in (f'private_key = "{long}"', f"credential: '{long}'", f"db_pwd = {long}", f'{"x" * 200}_pwd = "{long}"', f'db_pwd{wide}={wide}"{long}"', f"db_pwd{wide}:\t{wide}{long}"):
        assert [text[a:b] for a, b in secrets.named(text)] == [long] and long[-40:] not in secrets.redact(text)
    start = time.perf_counter()
    for text in ("a" * 500_000, "a= " + " " * 500_000, "a = \"" * 100_000, "a-" * 250_000 + "=", "a:" * 250_000, "ab \t" * 100_000 + "=", "A" * 500_000 + "a=1", "a='b=\"" * 80_000):
        secrets._PAIR.findall(text)
    for text in ('a = "' * 100_000, "a='b=\"" * 80_000, "a=[b=(" * 80_000, 'a="""' * 100_000, 'k="\\' * 100_000, "a=b;c=a;" * 50_000, "key=((((((" * 40_000):
        secrets.named(text + " token")
    assert time.perf_counter() - start < 10


def test_bucketed_texts_are_one_file_a_bucket(spark, monkeypatch):
    """However many tasks deal the texts, and however few ids they are joined with."""
    from contextlib import contextmanager

    rng, files, real = random.Random(4), [], jaccard.bucketed
    texts = [prose(rng, 30) for _ in range(60)]
    d = spark.createDataFrame([(i, texts[i % 60] + f" x{i}") for i in range(240)], "doc_id long, text string").repartition(12)

    @contextmanager
    def seen(df, name, by, buckets):
        with real(df, name, by, buckets) as t:
            files.append((len(t.inputFiles()), buckets))
            yield t

    monkeypatch.setattr(jaccard, "bucketed", seen)
    assert jaccard.classes(d).select("component_id").distinct().count() == 60
    assert files[0][0] <= files[0][1]


def test_toxicity(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(500):
        t = prose(rng, rng.randint(5, 60)).split()
        y = int(i % 4 == 0)
        if y:
            t[rng.randrange(len(t))] = rng.choice(["vilest", "vilely", "vileness", "vile"])
        rows.append((i, " ".join(t), "en", "s"))
        labels.append((i, 1, y))
    rows += [(9000, None, None, None), (9001, "", "en", "s"), (None, "x", "en", "s")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    lab = spark.createDataFrame(labels + [(None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.digest(d, lab).collect()}
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out.values())
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i].held_out == (i in set(held)) for i in range(500))
    assert sum(out[i].predicted == labels[i][2] for i in held) / len(held) >= 0.95
    assert toxicity.digest(d.limit(0), lab).count() == 0 and toxicity.digest(d, lab.limit(0)).count() == len(rows)
    assert toxicity.scored(docs_like(spark), toxicity.fit(d, lab.limit(0))).columns[-1] == "score"


def test_toxicity_learns_from_rows_beyond_its_sample(spark):
    """Thirty stems, each in few rows: a sample of 300 rows has too few of each."""
    rng = random.Random(7)
    stems = ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4)) for _ in range(30)]
    rows = []
    for i in range(1800):
        t = prose(rng, rng.randint(5, 30)).split()
        if i % 2:
            t[rng.randrange(len(t))] = stems[i // 2 % 30]
        rows.append((i, " ".join(t), i % 2))
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3, "doc_id")
    model = toxicity.fit(d.select("doc_id", "text"), d.where("doc_id < 1500").select("doc_id", "toxic"), "true", 300)
    out = toxicity.scored(d.where("doc_id >= 1500"), model).collect()
    assert sum((r.score >= 0.5) == (r.toxic == 1) for r in out) / len(out) >= 0.85


def test_stages_leave_no_memory_to_those_after(spark):
    import public_tokenizers
    from tidemark.llm import shared

    path = public_tokenizers.path(bpe.VOCABULARY)
    assert bpe.codec(path, public_tokenizers.PATTERN) is bpe.codec(path, public_tokenizers.PATTERN)
    assert list(shared.lean(lambda batches: batches)([1])) == [1] and bpe.codec.cache_info().currsize == 0
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    before = sum(b.getCollectionCount() for b in beans)
    n = shared.rested(spark)
    assert n == 2 * spark.sparkContext.defaultParallelism and sum(b.getCollectionCount() for b in beans) >= before + n // 2


def test_toxicity_joins_small_tables_as_it_joins_large_ones(spark):
    d = spark.createDataFrame([(i, f"word{i}") for i in range(40)], "doc_id long, text string")
    rows = toxicity.labelled(d, spark.createDataFrame([(i, i % 2) for i in range(0, 40, 3)], "doc_id long, toxic int"), "doc_id < 30")
    assert sorted((r.text, r.toxic) for r in rows.collect()) == sorted((f"word{i}", i % 2) for i in range(0, 30, 3))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_toxicity_sample_spans_the_table(spark):
    """The word bound goes by the hash of doc_id, not by the order of partitions, and one over-long text doesn't end the sample."""
    texts = [" ".join(["early" if i < 150 else "later"] * (5000 if i % 10 == 0 else 20)) for i in range(300)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartitionByRange(4, "doc_id")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    rows = toxicity.sampled(d, labels, "true", 12_000, 2000).collect()
    sizes = [r.n for r in rows]
    assert len({r.words[:4] for r in rows}) == 2 and set(sizes) == {20} and 40 <= len(sizes) <= 100
    assert sorted(r["first"] for r in rows) == list(range(0, 20 * len(rows), 20))
    assert (toxicity.TRAIN_ROWS, toxicity.TRAIN_WORDS) == (12_000, 6_000_000)


def test_toxicity_sample_is_gathered_whole():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 6, (n, 5)).astype(np.int32) for n in (4, 0, 7, 1, 9)]
    first = np.cumsum([0, *map(len, docs)])[:-1]
    rows = [{"first": int(a), "n": len(d), "words": d.tobytes(), "toxic": i % 2, "lang": i} for i, (a, d) in enumerate(zip(first, docs, strict=True))]
    schema = pa.schema([("first", pa.int64()), ("n", pa.int64()), ("words", pa.binary()), ("toxic", pa.int32()), ("lang", pa.int32())])
    batches = [pa.RecordBatch.from_pylist(rows[3:], schema=schema), pa.RecordBatch.from_pylist(rows[:3], schema=schema)]
    got, toxic, lang, table = toxicity.gathered(batches)
    order = sorted(range(5), key=lambda i: (first[i], len(docs[i])))
    assert len(np.unique(table, axis=0)) == len(table) and toxic.tolist() == [i % 2 for i in order] and lang.tolist() == order
    assert all(np.array_equal(table[g], docs[i]) for g, i in zip(got, order, strict=True))


def test_toxicity_model_survives_packing():
    m = toxicity.fitted([np.array([0, 1])] * 8, np.array([0, 1] * 4), np.zeros(8, dtype=np.int64), np.arange(10, dtype=np.int32).reshape(2, 5))
    n = toxicity.unpacked(toxicity.packed(m))
    assert n.keys() == m.keys() and all(np.array_equal(x, y) for k in m for x, y in zip(np.atleast_1d(m[k]) if k not in ("filters", "bias") else m[k], np.atleast_1d(n[k]) if k not in ("filters", "bias") else n[k], strict=True))


def docs_like(spark):
    return spark.createDataFrame([(1, "a b", 3.0)], "doc_id long, text string, SCORE double").drop("SCORE")


def test_mix(spark, empty):
    rng = random.Random(6)
    rows = [(i, None if i % 50 == 49 else prose(rng, rng.randint(1, 200)), "en", None if i % 10 == 9 else f"s{min(i % 10, 4)}") for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.mixed(d).collect()
    again = {r.doc_id: r.taken for r in mixing.mixed(d).collect()}
    size = {i: len((t or "").split()) for i, t, _, _ in rows}
    by, target, taken = {}, {}, {}
    for r in out:
        assert r["size"] == size[r.doc_id] and 0 <= r.taken <= 2 * r["size"] and again[r.doc_id] == r.taken
        by[r.source] = by.get(r.source, 0) + r["size"]
        target[r.source] = r.target
        taken[r.source] = taken.get(r.source, 0) + r.taken
    order = sorted(by, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want, left, open_ = {}, 1.5 * sum(by.values()), set(order)
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * level >= 2 * by[s]}
        if not over:
            want |= {s: w[s] * level for s in open_}
            break
        want |= {s: 2.0 * by[s] for s in over}
        left -= sum(2 * by[s] for s in over)
        open_ -= over
    assert len(out) == 400 and all(abs(want[s] - target[s]) < 1e-6 * want[s] and abs(taken[s] - target[s]) < 0.01 * target[s] + 1 for s in by)
    mixed = mixing.mix(d.withColumn("n_chars", F.lit(0).cast("long"))).collect()
    words_out = {}
    for r in mixed:
        words_out[r.doc_id] = words_out.get(r.doc_id, 0) + len(r.text.split())
        assert r.n_chars == len(r.text)
    assert words_out == {k: v for k, v in again.items() if v}
    assert mixing.mixed(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_mix_shards_come_from_the_draw(spark):
    """Counts by shard and source are a draw with exact totals; shards take those slots, each block once a round."""
    rows = [(s, k, n, n * 64, 64, k * 64) for s, k, n in (("a", 7000, 4000), ("b", 900, 1500), (None, 5, 3), ("z", 0, 0))]
    sources = spark.createDataFrame(rows, "source string, slots long, n_blocks long, source_size long, block long, words long")
    drawn = {(r.source, r.shard): r["count"] for r in mixing.draws(sources, shards=8).collect()}
    for s, n in (("a", 7000), ("b", 900), (None, 5)):
        counts = [drawn.get((s, k), 0) for k in range(8)]
        assert sum(counts) == n and (n < 100 or 0 < max(counts) - min(counts) and max(abs(c - n / 8) for c in counts) < 6 * (n / 8) ** 0.5)
    rows = mixing.slots(sources, shards=8).collect()
    by = {}
    for r in rows:
        by[r.source, r.shard] = by.get((r.source, r.shard), 0) + 1
    assert by == drawn and all(r.round == r.slot // {"a": 4000, "b": 1500, None: 3}[r.source] for r in rows)
    for s, n in (("a", 4000), (None, 3)):
        assert sorted(r.block_no for r in rows if r.source == s and r.round == 0) == list(range(n))
    # not in order
    first = [r.block_no for r in sorted((r for r in rows if r.source == "a" and r.round == 0), key=lambda r: r.slot)][:100]
    assert len({(b - a) % 4000 for a, b in zip(first, first[1:], strict=False)} - {1}) > 0


@pytest.mark.parametrize("block", [4096, 64, 7, 1])
def test_mix_meets_targets_to_the_word(spark, block):
    """Whatever the block: targets are met, no word is taken three times, and each row's words follow each other in its document."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range((i * 37) % 90)), f"s{min(i % 7, 3)}") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(2)
    target, taken = {}, {}
    for r in mixing.mixed(d, block=block, shards=3).collect():
        target[r.source] = r.target
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)
    whole = {i: t.split() for i, t, _ in rows}
    seen, pieces = {}, mixing.mix(d, block=block, shards=3).collect()
    for r in pieces:
        w = r.text.split()
        at = whole[r.doc_id].index(w[0])
        assert whole[r.doc_id][at : at + len(w)] == w
        for x in w:
            seen[x] = seen.get(x, 0) + 1
    assert max(seen.values()) <= 2 and sum(seen.values()) == sum(taken.values())


def test_mix_nulls_repeated_rows_and_clashes(spark):
    rows = [(1, "a b c", None), (1, "a b c", None), (None, "x y", "s"), (None, None, "s"), (2, "", ""), (3, "long " * 40_000, "s")]
    d = spark.createDataFrame([(*r, "clash", 7, "r") for r in rows], "doc_id long, text string, source string, shard string, size int, row string")
    out = mixing.mixed(d).collect()
    assert len(out) == len(rows) and all(0 <= r.taken <= 2 * r["size"] for r in out)
    got = mixing.mix(d, shard="part")
    assert got.columns == [*d.columns, "part"] and sum(len(r.text.split()) for r in got.collect()) == sum(r.taken for r in out)


def test_native_plans_have_no_python(spark, docs):
    c = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn int, role string, text string")
    for df in (mixing.mixed(docs), mixing.mix(docs), chat.digest(c)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "secret_scan", "source_mix", "byte_bpe"]
    d = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 2 = 0")
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = spark.createDataFrame(stage(spark, d, sf).collect(), d.schema)
        seen.append({r.doc_id for r in d.collect()})
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert seen[0] >= seen[1] >= seen[3] and seen[1] == seen[2]

"""URL filter, whitening and hard negatives against brute force, with nulls, ties, repeated rows, empty tables and clashing columns."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import hardneg, urlfilter, vectors, whitening


def as_regex(glob):
    out = ""
    for kind, c in urlfilter.parsed(glob):
        out += {"loop": ".*" if c == "**" else "[^/]*", "one": "[^/]", "char": re.escape(c)}[kind]
    return re.compile(out, re.S)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab/.*?\\é", max_size=9), min_size=1, max_size=30), st.lists(st.text("ab/.é😀\n", max_size=14), max_size=12))
def test_automaton_is_the_globs(globs, texts):
    got = urlfilter.Automaton(globs).matches(texts)
    assert got.tolist() == [[as_regex(g).fullmatch(t) is not None for g in globs] for t in texts]


def judged_plainly(url):
    """The contract, without an automaton."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [r for r in urlfilter.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    if fits:
        verdict, h, p = max(fits, key=lambda r: len(r[1] + r[2]))
        return host, path, h + p, verdict
    junk = "casino" in host or "-bets" in host or "ads-" in host or "/ads/" in path or path.endswith(".exe") or re.search(r"/wp-login\.ph[^/]\Z", path, re.S)
    return host, path, None, "block" if junk else "allow"


URLS = [
    None, "", "example.com/en/", "://", "http://", "https://example.com", "https://example.com/", "https://EXAMPLE.com/en/1", "https://www.example.com/en/1?x=/fr/", "http://m.www.example.com/en/",
    "http://example.com/EN/1", "http://notexample.com/en/1", "http://com/", "http://.com/", "http://com", "http://x.net/es/1", "http://x.net/es", "http://net/fr/#a", "http://x.net?/es/", "http://x.net#/fr/",
    "http://x.org/a.com/", "http://casino.org", "http://x.casino.net/en/", "http://x.org/casino", "http://best-bets.org/", "http://x.org/ads/1", "http://x.org/get.exe", "http://get.exe", "http://x.org/wp-login.php",
    "http://x.org/wp-login.phpp", "ftp://a://b.com/", "http://É.com/é", "http://a.org/*?", "http://x.net/es/" + "é/" * 60_000, "http://" + "a." * 40_000 + "net/fr/", "http://x.org/\n.exe", "http://u:p@x.com:80/",
]


def test_url_filter(spark):
    rng = random.Random(3)
    urls = URLS + ["http://" + "".join(rng.choice(["a", ".", "com", "net", "/", "en/", "es/", "www.example", "example", "?", "#"]) for _ in range(rng.randint(1, 9))) for _ in range(400)]
    rows = [(None if i % 11 == 3 else i // 2, u, "clash", i) for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule long")
    got = urlfilter.judged(df)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    want = sorted(((r[0], *judged_plainly(r[1])) for r in rows), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert urlfilter.judged(df.limit(0)).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_longest_rule_wins_and_ties(spark):
    df = spark.createDataFrame([(1, "http://a.com/x/"), (2, "http://b.org/q*r/1"), (3, "http://b.org/qzr/1")], "page_id long, url string")
    rules = [("allow", "com", "/x/aa"), ("allow", "com", "/x/"), ("block", "a.com", "/x"), ("block", "b.org", "/q*r")]
    assert [(r.rule, r.verdict) for r in urlfilter.judged(df, rules, []).orderBy("page_id").collect()] == [("a.com/x", "block"), ("b.org/q*r", "block"), (None, "allow")]


def test_packed_vectors():
    for x in ([0, -1, 32767], [40_000, -5], [1 << 40, 0, 3], [-32768]):
        ((own, back),) = vectors.unpack([vectors.pack(np.array(x))] * 2)
        assert own.tolist() == [0, 1] and back.tolist() == [x, x]


def vector_table(spark, n=400, dim=6, seed=1):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n, dim)) @ rng.normal(size=(dim, dim)) / 8).astype(np.float32)
    rows = [(i, [float(v) for v in r], "clash") for i, r in enumerate(x)]
    rows += [(7, rows[7][1], "again"), (None, rows[3][1], "null id"), (900, None, ""), (901, [0.1, None, 0.2, 0.0, 0.0, 0.0], ""), (902, [float("nan")] * dim, ""), (903, [float("inf")] * dim, ""), (904, [], "")]
    rows += [(1000 + i, rows[5][1], "hot") for i in range(n // 2)] + [(905, [0.5, 0.5], "short"), (906, [0.5, 0.25], "short")]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string")


def test_whitening(spark):
    rows, df = vector_table(spark)
    got = whitening.whitened(df).collect()
    kept = [(r[0], np.floor(256.0 * np.array(r[1], np.float32).astype(float)).astype(int)) for r in rows if r[1] and len(r[1]) == 6 and all(v is not None and np.isfinite(v) for v in r[1])]
    listed = np.unique(np.array([x for _, x in kept]), axis=0)
    n, s = len(listed), listed.sum(0)
    centre = listed - s / n
    values, axes = np.linalg.eigh(centre.T @ centre / n)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(got) == 4 * len(kept) and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-10
    white = {c: {} for c in (1, 2, 3, 4)}
    for r in got:
        white[r.component].setdefault(r.vec_id, []).append(r)
    for c in (1, 2, 3, 4):
        axis = axes[:, c - 1] * np.sign(axes[np.abs(axes[:, c - 1]).argmax(), c - 1])
        for i, x in kept:
            for r in white[c][i]:
                assert r.deviation == int(((n * x - s) ** 2).sum())
                assert abs(r.whitened - (x - s / n) @ axis / np.sqrt(values[c - 1])) < 1e-9
                assert abs(r.explained - values[c - 1] / values.sum()) < 1e-10
    assert len(white[1][7]) == 2 and len(white[1][None]) == 1


def test_whitening_of_few_or_no_vectors(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert whitening.whitened(df).count() == 0 and whitening.whitened(df.limit(0)).count() == 0
    # a line in three dimensions has one component
    line = spark.createDataFrame([(i, [i / 256, 2 * i / 256, 3 * i / 256]) for i in range(9)], "vec_id long, embedding array<double>")
    got = whitening.whitened(line).collect()
    assert len(got) == 9 and all(abs(r.explained - 1) < 1e-12 for r in got)
    huge = spark.createDataFrame([(i, [float(i << 25), 1.0 * i]) for i in range(40)], "vec_id long, embedding array<double>")
    n, s = 40, [sum(i << 33 for i in range(40)), sum(256 * i for i in range(40))]
    want = {i: (n * (i << 33) - s[0]) ** 2 + (n * 256 * i - s[1]) ** 2 for i in range(40)}
    for r in whitening.whitened(huge, components=1).collect():
        assert r.deviation == (want[r.vec_id] if want[r.vec_id] < 1 << 63 else None)


@pytest.mark.parametrize("dim", [1, 2, 5, 33, 64])
def test_jacobi_on_the_cholesky_factor(dim):
    rng = np.random.default_rng(dim)
    a = rng.normal(size=(3 * dim, dim)) * np.logspace(0, -6, dim)
    c = a.T @ a
    factor = whitening.pivoted_cholesky(c)
    assert np.allclose(factor @ factor.T, c, atol=1e-12)
    values, axes = whitening.jacobi(factor)
    assert np.allclose(axes.T @ axes, np.eye(dim), atol=1e-12) and (np.diff(values) <= 0).all()
    assert np.allclose(values, np.linalg.svd(a, compute_uv=False) ** 2, rtol=1e-6)
    low = whitening.pivoted_cholesky(np.outer(np.arange(dim + 1.0), np.arange(dim + 1.0)))
    assert low.shape == (dim + 1, 1)


def mined_plainly(rows, every):
    best = {}
    for i, x, label in rows:
        if i is None or label is None or not x or any(v is None or not np.isfinite(v) for v in x):
            continue
        q = tuple(int(np.floor(256.0 * float(np.float32(v)))) for v in x)
        best[i] = min(best.get(i, (label, vectors.pack(np.array(q)), q)), (label, vectors.pack(np.array(q)), q))
    out = set()
    for a, (la, _, qa) in best.items():
        if a % every:
            continue
        score = {b: int(np.dot(qa, qb)) for b, (_, _, qb) in best.items() if b != a and len(qb) == len(qa)}
        order = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in order if best[b][0] == la][:5]:
            neg = [b for b in order if best[b][0] != la and 30 * score[p] <= 100 * score[b] <= 90 * score[p]][:10]
            out |= {(a, p, k + 1, b, score[p], score[b]) for k, b in enumerate(neg)}
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_hard_negatives(spark, seed):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(9, 8))
    rows = []
    for i in range(900):
        label = int(rng.integers(9)) if rng.random() < 0.6 else 4
        x = middle[label] * rng.random() + 0.6 * rng.normal(size=8)
        x = np.round(x / np.linalg.norm(x), 1 if i % 3 else 6)  # rounded ones make ties
        rows.append((i - 50, [float(np.float32(v)) for v in x], label))
    rows += [rows[100], (rows[101][0], rows[200][1], 2), (None, rows[1][1], 1), (5000, None, 1), (5100, [], 1), (5200, [0.1] * 7 + [None], 1), (5300, [float("nan")] * 8, 1), (5400, rows[3][1], None), (6000, [0.5, 0.5], 1), (6001, [0.5, 0.4], 1), (6002, [0.5, 0.3], 2)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<float>, label int, id int")
    got = [tuple(r) for r in hardneg.hard_negatives(df.repartition(7), "id % 20 = 0").collect()]
    assert len(got) == len(set(got)) and set(got) == mined_plainly(rows, 20)
    assert hardneg.hard_negatives(df.limit(0), "id % 20 = 0").count() == 0
    assert hardneg.hard_negatives(df.where("label = 4"), "id % 20 = 0").count() == 0


def test_trees_of_many_levels(monkeypatch):
    monkeypatch.setattr(hardneg, "LEAF", 8)
    monkeypatch.setattr(hardneg, "FANOUT", 3)
    rng = np.random.default_rng(5)
    x = rng.integers(-20, 20, size=(1100, 4))
    labels, ids = np.sort(rng.integers(0, 6, 1100)), rng.permutation(1100)
    order, lo, hi = hardneg.Tree.packed(ids, labels, x, np.arange(4))
    assert sorted(order) == list(range(1100)) and (labels[order] == labels).all()
    tree = hardneg.Tree(ids[order], labels[order], x[order].astype(float), lo, hi)
    assert len(tree.lo) > 3
    opened = 0
    for a in range(0, 1100, 60):
        q = x[a].astype(float)
        bounds = [(one[0], two[0]) for one, two in tree.bounds(q[None])]
        score = x @ q
        inside = bounds[0]
        assert all((inside[0][i // 8] <= score[order[i]] <= inside[1][i // 8]) for i in range(1100))
        for same in (True, False):
            low, high = np.array([-np.inf, 10.0, 200.0]), np.array([np.inf, 50.0, 240.0])
            got = tree.search(q, ids[a], labels[a], same, low, high, 7, bounds)
            for w in range(3):
                want = [i for i in range(1100) if i != a and (labels[i] == labels[a]) == same and low[w] <= score[i] <= high[w]]
                want = sorted(want, key=lambda i: (-score[i], ids[i]))[:7]
                assert got[w][0].tolist() == [ids[i] for i in want] and got[w][1].tolist() == [score[i] for i in want]
        opened += int((bounds[0][1] >= 200).sum())
    assert opened < 19 * len(tree.lo[0])  # some boxes can't hold what a window wants


def test_queries_over_the_tables(spark):
    from tidemark.llm import queries

    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, list(r.embedding), (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert set(map(tuple, queries.op13_hard_negatives(spark, sf).collect())) == mined_plainly(rows, 100)
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()
    assert sorted(map(tuple, queries.op11_url_filter(spark, sf).collect()), key=str) == sorted(((p.page_id, *judged_plainly(p.url)) for p in pages), key=str)
    assert queries.op12_whitening(spark, sf).count() == 4 * len(rows)

"""Toxicity scores by a convolutional text classifier trained in numpy.

A word (lower-case run of ASCII letters, digits and all other non-ASCII bytes) is embedded as the sum of hashed vectors of
itself and of its prefixes of 3, 4, 5 and 6 bytes, so that inflected forms share what they have learnt. Filters of widths 1, 2
and 3 run over the embedded words, each filter keeps its maximum over the whole text, and a logistic unit scores the maxima.
Training: every labelled row takes part. Three quarters of them, by a hash of doc_id, fit the classifier, the others its thresholds.
The fit starts from a bounded sample of the first (``TRAIN_ROWS``, ``TRAIN_WORDS``; Adam, in one task on an executor). Then all of
them train it in ``ROUNDS`` rounds: each task goes on from the model over its own rows (those of an Arrow batch ``REPEATS`` times),
and what the tasks have learnt is averaged -
an embedding over the tasks that met it, by how often they did. A task holds one Arrow batch; sums of changes are streamed by ranges
of the table of embeddings, and only the finished model comes to the driver. Calibration: all other labelled rows are scored and counted by
language, label and score (in steps of 1/256); each language - guessed from the text by its commonest short words, never read from
a column - gets the logit at which balanced accuracy is best; scores are shifted so that 0.5 is that threshold.

Null and wordless texts score as a text without any filter response. Labels are joined by doc_id; null labels are left out;
a doc_id with several labels counts as toxic if any is. Repeated rows each get their score. Without any labels scores are 0.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import lean, with_field, written
from tidemark.llm.words import U, chunks, prefix_sums, span_hashes, spans

TRAIN_ROWS, TRAIN_WORDS = 12_000, 6_000_000
ROUNDS, REPEATS, BATCH, RATE, PARTS, GRID, TOP = 2, 3, 64, 0.01, 16, 256, 60
BITS, DIM, FILTERS, WIDTHS, PREFIXES = 17, 8, 12, (1, 2, 3), (3, 4, 5, 6)
#: Frequent short words that tell the languages of the calibration apart.
LANGUAGE_WORDS = {"en": "the and of to in is that for".split(), "fr": "les des et la une est que dans".split(), "de": "der die und das ist ein nicht zu".split(), "es": "el los las en una por con del".split()}
LANGUAGES = (*LANGUAGE_WORDS, "other")
_SEP = np.ones(256, dtype=bool)
_SEP[128:] = False
_SEP[48:58] = _SEP[65:91] = _SEP[97:123] = False
_SEP[95] = False


def _language_hashes() -> tuple[np.ndarray, np.ndarray]:
    values, langs = [], []
    for i, ws in enumerate(LANGUAGE_WORDS.values()):
        for w in ws:
            b = np.frombuffer(w.encode(), dtype=np.uint8)
            values.append(span_hashes(prefix_sums(b), np.array([0]), np.array([len(b)]))[0])
            langs.append(i)
    values, langs = np.array(values, dtype=U), np.array(langs)
    o = np.argsort(values)
    return values[o], langs[o]


def features(column: pa.Array):
    """By chunk: buckets of each word's own hash and prefixes (words, 1 + PREFIXES), first word by document, language."""
    known, lang = _language_hashes()
    for _, _, buf, off in chunks(column):
        starts, ends, first = spans(buf, off, _SEP)
        cum = prefix_sums(buf)
        own = span_hashes(cum, starts, ends)
        out = np.empty((len(starts), 1 + len(PREFIXES)), dtype=np.int32)
        out[:, 0] = own >> U(64 - BITS)
        for i, k in enumerate(PREFIXES, 1):
            out[:, i] = span_hashes(cum, starts, np.minimum(starts + k, ends), k) >> U(64 - BITS)
        at = np.searchsorted(known, own)
        at[at == len(known)] = 0
        hit = np.flatnonzero(known[at] == own)
        n = len(off) - 1
        doc = np.searchsorted(first, hit, "right") - 1
        votes = np.bincount(doc * len(LANGUAGE_WORDS) + lang[at[hit]], minlength=n * len(LANGUAGE_WORDS)).reshape(n, -1)
        yield out, first, np.where(votes.max(1) > 0, votes.argmax(1), len(LANGUAGE_WORDS))


def conv(model: dict, buckets: np.ndarray, first: np.ndarray):
    """Maxima of each filter by document (0 without a response) and where they are."""
    x = model["embed"][buckets[:, 0]]
    for i in range(1, buckets.shape[1]):
        x = x + model["embed"][buckets[:, i]]
    n, docs = len(x), len(first) - 1
    full = np.flatnonzero(first[1:] > first[:-1])
    pooled, where = [], []
    for width, w in zip(WIDTHS, model["filters"], strict=True):
        y = x @ w[:DIM]
        for j in range(1, width):
            y[: n - j] += x[j:] @ w[j * DIM : (j + 1) * DIM]
        y += model["bias"][WIDTHS.index(width)]
        # windows that would reach into the next document take no part
        for j in range(1, width):
            y[np.clip(first[1:][full] - j, 0, None)] = -1
        p = np.zeros((docs, w.shape[1]), dtype=np.float32)
        if len(full):
            p[full] = np.maximum(np.maximum.reduceat(y, first[:-1][full], axis=0), 0)
        pooled.append(p)
        where.append(y)
    return x, np.concatenate(pooled, 1), where


def logits(model: dict, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
    return conv(model, buckets, first)[1].astype(np.float64) @ model["out"] + model["offset"]


def _adam(state: dict, key: str, value: np.ndarray, grad: np.ndarray) -> None:
    t = state["t"]
    m, v = state.setdefault(key, (np.zeros_like(value), np.zeros_like(value)))
    m *= 0.9
    m += 0.1 * grad
    v *= 0.99
    v += 0.01 * grad * grad
    value -= state["rate"] * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)


def class_weights(positive: float) -> np.ndarray:
    """Weights of a row of label 0 and 1 at which both classes weigh the same."""
    positive = max(positive, 1e-3)
    return np.array([0.5 / max(1 - positive, 1e-3), 0.5 / positive])


def stepped(model: dict, state: dict, buckets: np.ndarray, first: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> None:
    """One step over a few documents, in place. Gradients flow through the maxima only, so they are sparse. state: t, rate, and touched
    where the steps that met each embedding are to be counted."""
    state["t"] += 1
    x, pooled, ys = conv(model, buckets, first)
    p = 1 / (1 + np.exp(-np.clip(pooled @ model["out"] + model["offset"], -30, 30)))
    g = (p - labels) * weight / len(labels)
    _adam(state, "out", model["out"], pooled.T @ g + 1e-4 * model["out"])
    model["offset"] -= 5 * state["rate"] * g.sum()
    back = g[:, None] * model["out"][None]
    touched, grads = [], []
    for b, width in enumerate(WIDTHS):
        part = slice(b * FILTERS, (b + 1) * FILTERS)
        d, k = np.nonzero(pooled[:, part] > 0)
        if not len(d):
            continue
        at = np.empty(len(d), dtype=np.int64)
        for u in np.unique(d):
            own = d == u
            at[own] = first[u] + ys[b][first[u] : first[u + 1], k[own]].argmax(0)
        gy = back[:, part][d, k].astype(np.float32)
        window = np.concatenate([x[np.minimum(at + j, len(x) - 1)] for j in range(width)], 1)
        w = model["filters"][b]
        gw = np.zeros_like(w)
        np.add.at(gw.T, k, window * gy[:, None])
        gb = np.bincount(k, gy, FILTERS).astype(np.float32)
        wide = w.T[k] * gy[:, None]
        for j in range(width):
            touched.append(at + j)
            grads.append(wide[:, j * DIM : (j + 1) * DIM])
        _adam(state, f"w{b}", w, gw)
        _adam(state, f"b{b}", model["bias"][b], gb)
    if touched:
        rows = buckets[np.minimum(np.concatenate(touched), len(buckets) - 1)]
        grad = np.repeat(np.concatenate(grads), rows.shape[1], axis=0)
        ids, place = np.unique(rows.ravel(), return_inverse=True)
        total = np.zeros((len(ids), DIM), dtype=np.float32)
        np.add.at(total, place, grad)
        model["squares"][ids] += (total**2).mean(1)
        model["embed"][ids] -= 0.1 * total / np.sqrt(model["squares"][ids])[:, None]
        if "touched" in state:
            state["touched"][ids] += 1


def train(docs: list[np.ndarray], labels: np.ndarray, table: np.ndarray, epochs: int = 6, batch: int = BATCH, seed: int = 5) -> dict:
    """The classifier of word numbers by document, 0/1 labels, and the buckets of each word."""
    rng = np.random.default_rng(seed)
    f = len(WIDTHS) * FILTERS
    model = {
        "embed": rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32),
        "filters": [rng.normal(0, 1 / np.sqrt(DIM), (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        "bias": [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS],
        "out": rng.normal(0, 0.3, f),
        "offset": 0.0,
        "shift": np.zeros(len(LANGUAGES)),
        "squares": np.full(1 << BITS, 1e-6, dtype=np.float32),
    }
    if not len(docs):
        return model
    state = {"t": 0, "rate": 0.02}
    weight = class_weights(labels.mean())[labels]
    sizes = np.array([len(d) for d in docs])
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            stepped(model, state, table[np.concatenate([docs[k] for k in pick])], np.concatenate([[0], np.cumsum(sizes[pick])]), labels[pick], weight[pick])
    return model


def calibrate(model: dict, scores: np.ndarray, languages: np.ndarray, counts: np.ndarray) -> None:
    """By language, the logit between classes at which balanced accuracy is best; the midpoint of the best gap. counts (n, 2): rows of
    label 0 and 1 at each score."""

    def best(s, n):
        if not len(s) or not n.sum(0).all():
            return None
        s, place = np.unique(s, return_inverse=True)
        n = np.stack([np.bincount(place, n[:, y], len(s)) for y in (0, 1)], 1)
        cut = np.concatenate([[s[0] - 1], (s[1:] + s[:-1]) / 2, [s[-1] + 1]])
        below = np.concatenate([[[0, 0]], np.cumsum(n, 0)]) / n.sum(0)
        right = below[:, 0] + 1 - below[:, 1]
        top = np.flatnonzero(right >= right.max() - 1e-12)
        return cut[top[len(top) // 2]]

    overall = best(scores, counts)
    for i in range(len(LANGUAGES)):
        own = languages == i
        b = best(scores[own], counts[own]) if counts[own].sum() >= 30 else None
        model["shift"][i] = b if b is not None else overall if overall is not None else 0.0


def marked(labels: DataFrame) -> DataFrame:
    """doc_id, toxic: one row a labelled document."""
    return labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def sampled(documents: DataFrame, labels: DataFrame, usable: str, rows: int, words: int) -> DataFrame:
    """first, n, words, toxic, lang of at most `rows` labelled documents and `words` words: each with the place of its first
    word among all words of the sample.

    Both bounds go by the hash of doc_id over the whole table; a text that would pass the word bound is left out, not those after it.
    """
    # about equally many of either class where the table has them
    usable_rows = marked(labels).where(usable)
    n = {r["toxic"]: r["n"] for r in usable_rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for y in (0, 1):
        share = min(1.0, rows / 2 / max(n.get(y, 0), 1))
        some = usable_rows.where((F.col("toxic") == y) & (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 62)) < F.lit(int(share * (1 << 62)))))
        picked = some if picked is None else picked.union(some)

    # at most `rows` rows of two columns: small enough to broadcast at any size of the corpus, so texts aren't shuffled
    picked = F.broadcast(picked.orderBy(F.xxhash64("doc_id", F.lit(12))).limit(rows))

    def run(batches):
        for batch in batches:
            at = 0
            for buckets, first, lang in features(batch.column(1)):
                k = len(lang)
                own = [buckets[first[i] : first[i + 1]].tobytes() for i in range(k)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + k], pa.array(own, pa.binary()), pa.array(np.diff(first), pa.int64()), batch.column(2)[at : at + k].cast(pa.int32()), pa.array(lang, pa.int32())], ["doc_id", "words", "n", "toxic", "lang"])
                at += k

    got = documents.select("doc_id", "text").join(picked, "doc_id").select("doc_id", "text", "toxic").mapInArrow(run, "doc_id long, words binary, n long, toxic int, lang int")
    got = written(got.select("*", F.xxhash64("words").alias("hash"), F.monotonically_increasing_id().alias("row")), "sample")
    # numbers of at most `rows` rows, however often a doc_id is repeated; the words themselves don't come to the driver
    order = [F.xxhash64("doc_id", F.lit(12)), "doc_id", "hash", "row"]
    chosen, held = [], 0
    for r in got.select("doc_id", "n", "hash", "row").orderBy(*order).limit(rows).collect():
        if held + r["n"] <= words:
            chosen.append(r)
            held += r["n"]
    places, at = [], 0
    for r in sorted(chosen, key=lambda r: r["doc_id"]):
        places.append((r["row"], at))
        at += r["n"]
    places = documents.sparkSession.createDataFrame(places, "row long, first long")
    return got.join(F.broadcast(places), "row").select("first", "n", "words", "toxic", "lang")


def distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a matrix of int32, and the place of each row among them."""
    wide = np.ascontiguousarray(rows).view([("", rows.dtype)] * rows.shape[1]).ravel()
    _, first, place = np.unique(wide, return_index=True, return_inverse=True)
    return rows[first], place.astype(np.int32)


def gathered(batches) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers by document, labels, languages, and the buckets of each word by its number, of the rows of a sample, in the
    order of `first`. Words repeat, so only the distinct ones of a batch are held with their buckets."""
    parts, tables, size = [], [], 0
    for batch in batches:
        firsts, ns, raws, toxic, lang = (c.to_pylist() for c in batch.columns)
        table, place = distinct(np.frombuffer(b"".join(raws), dtype=np.int32).reshape(-1, 1 + len(PREFIXES)))
        tables.append(table)
        for at, *row in zip(np.cumsum([0, *ns[:-1]]).tolist(), firsts, ns, toxic, lang, strict=True):
            parts.append((*row, place[at : at + row[1]] + np.int32(size)))
        size += len(table)
    parts.sort(key=lambda x: x[:2])  # texts without words share their place, and are alike but for their label
    if not parts:
        return [], np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty((0, 1 + len(PREFIXES)), dtype=np.int32)
    table, place = distinct(np.concatenate(tables))
    return [place[p[4]] for p in parts], np.array([p[2] for p in parts], dtype=np.int64), np.array([p[3] for p in parts], dtype=np.int64), table


def fitted(docs: list[np.ndarray], ys: np.ndarray, langs: np.ndarray, table: np.ndarray) -> dict:
    """The classifier that the rounds over all rows start from, of the documents of a sample; its thresholds, of the same documents, stand
    only if no other row has a label."""
    model = train(docs, ys, table)
    scores = np.empty(len(docs))
    for i in range(0, len(docs), 16):
        part = docs[i : i + 16]
        scores[i : i + 16] = logits(model, table[np.concatenate(part)], np.concatenate([[0], np.cumsum([len(d) for d in part])]))
    calibrate(model, scores, langs, np.stack([ys == 0, ys == 1], 1).astype(np.int64))
    return model


def packed(model: dict) -> bytes:
    out = io.BytesIO()
    arrays = {"embed": model["embed"], "out": model["out"], "offset": np.array(model["offset"]), "shift": model["shift"], "squares": model["squares"]}
    for i in range(len(WIDTHS)):
        arrays |= {f"filters{i}": model["filters"][i], f"bias{i}": model["bias"][i]}
    np.savez(out, **arrays)
    return out.getvalue()


def unpacked(raw: bytes) -> dict:
    a = np.load(io.BytesIO(raw))
    each = range(len(WIDTHS))
    return {"embed": a["embed"], "filters": [a[f"filters{i}"] for i in each], "bias": [a[f"bias{i}"] for i in each], "out": a["out"], "offset": float(a["offset"]), "shift": a["shift"], "squares": a["squares"]}


def _dense(model: dict) -> np.ndarray:
    """All parameters but the embeddings, in one vector."""
    return np.concatenate([*(w.ravel() for w in model["filters"]), *model["bias"], model["out"], [model["offset"]]]).astype(np.float64)


def _with_dense(model: dict, v: np.ndarray) -> dict:
    cuts = np.cumsum([*(w.size for w in model["filters"]), *(b.size for b in model["bias"]), model["out"].size])
    *parts, offset = np.split(v, cuts)
    k = len(WIDTHS)
    filters = [p.reshape(w.shape).astype(np.float32) for p, w in zip(parts[:k], model["filters"], strict=True)]
    return model | {"filters": filters, "bias": [p.astype(np.float32) for p in parts[k : 2 * k]], "out": parts[-1].copy(), "offset": float(offset[0])}


_CHANGES = "part int, ids binary, values binary"
_WIDE = 2 + DIM  # steps that met an embedding, what its squares gained, and its change times those steps


def _changes(parts) -> pa.RecordBatch:
    cols = list(zip(*parts, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array([x.tobytes() for x in c], pa.binary()) for c in cols[1:])], ["part", "ids", "values"])


def _summed(batches):
    """The sums of the changes of each range of embeddings (and of the vector of the other parameters, the last range)."""
    held: dict[int, np.ndarray] = {}
    size = 1 << BITS
    for batch in batches:
        for part, ids, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids, values = np.frombuffer(ids, np.int32), np.frombuffer(values, np.float32 if part < PARTS else np.float64)
            if part not in held:
                held[part] = np.zeros((size // PARTS, _WIDE)) if part < PARTS else np.zeros(len(values))
            if part < PARTS:
                held[part][ids - part * (size // PARTS)] += values.reshape(-1, _WIDE)
            else:
                held[part] += values
    out = []
    for part, v in held.items():
        if part < PARTS:
            at = np.flatnonzero(v[:, 0])
            out.append((part, (at + part * (size // PARTS)).astype(np.int32), v[at].astype(np.float32)))
        else:
            out.append((part, np.empty(0, np.int32), v))
    yield _changes(out)


def improved(rows: DataFrame, model: dict, weight: np.ndarray) -> dict:
    """The model after one round over rows (text, toxic): each task goes on from it over its own rows, and the changes are averaged."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        start = shared.value
        own = _with_dense(start, _dense(start)) | {"embed": start["embed"].copy(), "squares": start["squares"].copy()}
        state = {"t": 0, "rate": RATE, "touched": np.zeros(1 << BITS, dtype=np.float32)}
        n = 0
        for batch in batches:
            toxic, at = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64), 0
            for buckets, first, lang in features(batch.column(0)):
                for i in [*range(0, len(lang), BATCH)] * REPEATS:
                    j = min(i + BATCH, len(lang))
                    y = toxic[at + i : at + j]
                    stepped(own, state, buckets[first[i] : first[j]], first[i : j + 1] - first[i], y, weight[y])
                at += len(lang)
            n += batch.num_rows
        if not n:
            return
        met = np.flatnonzero(state["touched"])
        steps = state["touched"][met]
        values = np.column_stack([steps, own["squares"][met] - start["squares"][met], (own["embed"][met] - start["embed"][met]) * steps[:, None]]).astype(np.float32)
        cut = np.searchsorted(met, np.arange(PARTS + 1) * ((1 << BITS) // PARTS))
        parts = [(k, met[a:b].astype(np.int32), values[a:b]) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
        yield _changes([*parts, (PARTS, np.empty(0, np.int32), np.append(_dense(own) * n, n))])

    # rows of one size or smaller however many tasks there are; the finished sums have the size of the model
    got = rows.mapInArrow(lean(run), _CHANGES).repartition(PARTS + 1, "part").mapInArrow(_summed, _CHANGES).collect()
    shared.destroy()
    out = model | {"embed": model["embed"].copy(), "squares": model["squares"].copy()}
    for part, ids, values in got:
        if part == PARTS:
            v = np.frombuffer(values, np.float64)
            out = _with_dense(out, v[:-1] / v[-1])
        else:
            ids, v = np.frombuffer(ids, np.int32), np.frombuffer(values, np.float32).reshape(-1, _WIDE)
            out["embed"][ids] += v[:, 2:] / v[:, :1]
            out["squares"][ids] += v[:, 1]
    return out


def counted(rows: DataFrame, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores (steps of 1 / GRID up to TOP), languages and numbers of rows of either label, of all rows (text, toxic)."""
    shared, wide = rows.sparkSession.sparkContext.broadcast(model), 2 * TOP * GRID + 1

    def run(batches):
        m, n = shared.value, np.zeros(len(LANGUAGES) * wide * 2, np.int64)
        for batch in batches:
            toxic, at = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64), 0
            for buckets, first, lang in features(batch.column(0)):
                z = np.round(np.clip(logits(m, buckets, first), -TOP, TOP) * GRID).astype(np.int64) + TOP * GRID
                np.add.at(n, (lang * wide + z) * 2 + (toxic[at : at + len(lang)] > 0), 1)
                at += len(lang)
        key = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n[key])], ["key", "n"])

    # at most languages x steps x labels rows
    got = rows.mapInArrow(lean(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
    shared.destroy()
    key, n = np.array([r["key"] for r in got], np.int64), np.array([r["n"] for r in got], np.int64)
    at, place = np.unique(key // 2, return_inverse=True)
    counts = np.zeros((len(at), 2), np.int64)
    np.add.at(counts, (place, key % 2), n)
    return (at % wide - TOP * GRID) / GRID, at // wide, counts


def labelled(documents: DataFrame, labels: DataFrame, which: str) -> DataFrame:
    """text, toxic of the labelled documents for which an expression of doc_id holds. What doesn't take part goes before the join, so few
    texts are shuffled at a time. Tables of any size are joined in the same way: else few labels would be broadcast and only larger tables
    shuffled, and what a small table needs would say nothing of a large one."""
    return documents.select("doc_id", "text").where(which).join(marked(labels).where(which).hint("merge"), "doc_id").select("text", "toxic")


def fit(documents: DataFrame, labels: DataFrame, usable: str = "true", rows: int = TRAIN_ROWS, words: int = TRAIN_WORDS) -> dict:
    """The classifier of all labelled documents for which `usable`, an expression of doc_id, holds. It starts from at most `rows` of them and
    `words` words (see sampled); then each labelled row takes part once, in the fit or in the thresholds."""

    def run(batches):
        yield pa.RecordBatch.from_arrays([pa.array([packed(fitted(*gathered(batches)))], pa.binary())], ["model"])

    mine = f"({usable}) and pmod(xxhash64(doc_id, 13), 4) > 0"
    # the sample is bounded, so one task can hold it; the model has a fixed size
    got = sampled(documents, labels, mine, rows, words).repartition(1).mapInArrow(lean(run), "model binary").collect()
    model = unpacked(got[0]["model"]) if got else fitted(*gathered([]))

    n = {r["y"]: r["n"] for r in marked(labels).where(mine).groupBy((F.col("toxic") > 0).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    weight = class_weights(n.get(1, 0) / max(sum(n.values()), 1))
    for k in range(ROUNDS if n else 0):
        model = improved(labelled(documents, labels, f"{mine} and pmod(xxhash64(doc_id, 14), {ROUNDS}) = {k}"), model, weight)
    found = counted(labelled(documents, labels, f"({usable}) and pmod(xxhash64(doc_id, 13), 4) = 0"), model)
    if found[2].sum() < 60:  # too few for thresholds of their own
        found = counted(labelled(documents, labels, usable), model)
    if len(found[0]):
        calibrate(model, *found)
    return model


def scored(documents: DataFrame, model: dict, out: str = "score") -> DataFrame:
    """documents with a score in [0, 1] of the text column."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)  # fixed size: 2**BITS * DIM floats
    base = documents.drop(out) if out in documents.columns else documents
    at = base.columns.index("text")

    def run(batches):
        m = shared.value
        for batch in batches:
            got = []
            for buckets, first, lang in features(batch.column(at)):
                z = logits(m, buckets, first) - m["shift"][lang]
                got.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            s = pa.array(np.concatenate(got) if got else np.empty(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, s], [*batch.schema.names, out])

    return base.mapInArrow(lean(run), with_field(base, out, "double"))


HELD_OUT = "crc32(cast(doc_id as string)) % 5 = 0"


def digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of held-out rows are never read into the fit."""
    d = documents.select("doc_id", "text")
    model = fit(d, labels.select("doc_id", "toxic"), f"not ({HELD_OUT})")
    s = scored(d, model)
    return s.select("doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

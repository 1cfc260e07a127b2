"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), x_i = 1 if a term of bucket i occurs.
The pair term is computed as half of (sum_i v_i)^2 - sum_i v_i^2 per factor.  Terms are lower-cased
words and their first four and five bytes, so inflected forms share what was learned.

The model is fitted on a bounded sample of labelled rows (``PER_CLASS`` rows of each label, those
with the smallest hash of doc_id).  Every bucket of their terms has a weight and factors; the
hashed space bounds the model (``BITS``), so it is broadcast.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidebar.llm.textbatch import ALNUM_LOWER, Words, slices, word_hashes

PER_CLASS = 8000  # labelled rows of each class that the fit may use
BITS = 20  # hashed term space
FACTORS = 8
EPOCHS = 12
RATE = 0.2
DECAY = 1e-4  # of factors, per row
START = 0.1  # of the squared gradients
SHRINK_W = 40  # evidence at which a weight learns at half its scale
SHRINK_V = 1000  # documents at which factors do
BATCH = 256  # rows of a minibatch
TERMS_AT_ONCE = 1 << 18
SLICE = 1 << 20  # bytes of text whose terms are worked on at once
PREFIXES = (4, 5)


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def term_pairs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every term; repeats are left in."""
    words = Words(texts, ALNUM_LOWER)
    doc, keys, owners = words.doc, [words.hashes], [words.doc]
    for k in PREFIXES:
        long = words.ends - words.starts > k
        starts = words.starts[long]
        keys.append(word_hashes(words.buf, starts, starts + k) ^ np.uint64(k))
        owners.append(doc[long])
    return np.concatenate(owners), (np.concatenate(keys) >> np.uint64(64 - BITS)).astype(np.int64)


def counted(cols: np.ndarray, size: int) -> np.ndarray:
    """How often each of ``size`` numbers occurs; part after part, since a count widens its input."""
    out = np.zeros(size, np.int64)
    for a in range(0, len(cols), 1 << 20):
        out += np.bincount(cols[a : a + (1 << 20)], minlength=size)
    return out


def evidence(seen: np.ndarray, toxic: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared difference of each bucket's document shares between the classes, in standard errors; from its documents and toxic documents."""
    c, share, n = seen.astype(float), y.mean(), len(y)
    return (toxic - c * share) ** 2 / (c * share * (1 - share) * np.maximum(1 - c / n, 1 / n))


def sums(x: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Sums of the rows between edges; an empty run gives 0."""
    upto = np.zeros((len(x) + 1, x.shape[1]))
    np.cumsum(x, axis=0, dtype=float, out=upto[1:])
    return upto[edge[1:]] - upto[edge[:-1]]


def minibatches(order: np.ndarray, size: np.ndarray):
    """Runs of at most BATCH rows, shorter ones where rows have many terms."""
    a, upto = 0, np.cumsum(size[order])
    while a < len(order):
        b = int(np.searchsorted(upto, (upto[a - 1] if a else 0) + TERMS_AT_ONCE, "right"))
        b = max(a + 1, min(a + BATCH, b))
        yield order[a:b]
        a = b


def fit(doc: np.ndarray, bucket: np.ndarray, y: np.ndarray, prior: float, seed: int = 7) -> dict:
    """Sparse minibatches (AdaGrad, logistic loss) over every bucket that occurs in the rows.

    Parameters are learnt times a fixed scale: of a weight by the evidence for the bucket, of factors
    by its documents.  Chance differences of the many rare buckets so move slowly, none is left out.
    Of the arrays with an entry per term (32 bits, where the caller's have) few exist at a time.
    """
    if (doc[1:] < doc[:-1]).any():
        order = np.argsort(doc, kind="stable")
        doc, bucket = doc[order], bucket[order]
    slot = np.zeros(1 << BITS, np.int32)
    slot[bucket] = 1
    chosen = np.flatnonzero(slot)
    slot[chosen] = np.arange(len(chosen), dtype=np.int32)
    cols = slot[bucket]
    seen = counted(cols, len(chosen))
    found = evidence(seen, counted(cols[(y == 1)[doc]], len(chosen)), y) + 1
    scale = np.repeat((seen / (seen + SHRINK_V)).astype(np.float32)[:, None], 1 + FACTORS, 1)
    scale[:, 0] = found / (found + SHRINK_W)
    edge = np.searchsorted(doc, np.arange(len(y) + 1, dtype=doc.dtype))
    size = np.diff(edge)
    rng = np.random.default_rng(seed)
    share = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
    w0, s0 = np.log(share / (1 - share)), START
    p = np.empty((len(chosen), 1 + FACTORS), np.float32)  # weight, factors
    for a in range(0, len(p), 1 << 16):
        p[a : a + (1 << 16)] = rng.normal(0, 0.02, p[a : a + (1 << 16)].shape)
    p[:, 0] = 0
    s = np.full_like(p, START)
    for _ in range(EPOCHS):
        for pick in minibatches(rng.permutation(len(y)), size):
            n = size[pick]
            at = np.concatenate([[0], np.cumsum(n)])
            c = cols[np.arange(at[-1]) + np.repeat(edge[pick] - at[:-1], n)]
            x = p[c] * scale[c]
            total = sums(x, at)
            xv = total[:, 1:]
            z = w0 + total[:, 0] + 0.5 * ((xv**2).sum(1) - sums(x[:, 1:] ** 2, at).sum(1))
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]
            s0 += g.sum() ** 2
            w0 -= RATE * g.sum() / np.sqrt(s0)
            if not len(c):
                continue
            by = np.argsort(c, kind="stable")
            first = np.flatnonzero(np.diff(c[by], prepend=-1))
            u, row = c[by[first]], np.repeat(np.arange(len(pick)), n)[by]
            d = np.empty((len(c), 1 + FACTORS), np.float32)
            d[:, 0] = g[row]
            d[:, 1:] = d[:, :1] * xv[row]
            d = np.add.reduceat(d, first, 0)
            d[:, 1:] = (d[:, 1:] - d[:, :1] * p[u, 1:] * scale[u, 1:]) * scale[u, 1:] + DECAY * len(pick) * p[u, 1:]
            d[:, 0] *= scale[u, 0]
            s[u] += d**2
            p[u] -= RATE * d / np.sqrt(s[u])
    p *= scale
    prior = min(max(prior, 1e-6), 1 - 1e-6)
    w0 += np.log(prior / (1 - prior)) - np.log(share / (1 - share))  # the sample is balanced, the corpus is not
    return {"chosen": chosen, "w0": float(w0), "w": p[:, 0].copy(), "v": p[:, 1:].copy()}


def predict(model: dict, texts: list[bytes]) -> np.ndarray:
    doc, bucket = term_pairs(texts)
    slot = model["slot"][bucket]
    key = np.unique((doc[slot >= 0].astype(np.int64) << BITS) + slot[slot >= 0])
    doc, slot = key >> BITS, key & ((1 << BITS) - 1)
    v, n = model["v"][slot], len(texts)
    z = model["w0"] + np.bincount(doc, model["w"][slot], n)
    for f in range(v.shape[1] if len(v) else 0):
        z += 0.5 * (np.bincount(doc, v[:, f], n) ** 2 - np.bincount(doc, v[:, f] ** 2, n))
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> dict:
    """Fit on labelled rows outside the held-out fold.

    Null labels and ids are left out; a doc_id with several labels counts as toxic if any says so.
    Without rows of both classes the model is a constant: the smoothed share of toxic labels.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("y"))
    n1, n = known.agg(F.sum("y"), F.count("*")).first()
    prior = ((n1 or 0) + 0.5) / (n + 2)  # without any label documents stay on the clean side
    constant = {"chosen": np.zeros(0, np.int64), "w0": float(np.log(prior / (1 - prior))), "w": np.zeros(0), "v": np.zeros((0, FACTORS))}
    if not n1 or n1 == n:
        return constant
    some = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    picked = F.broadcast(some[0].unionByName(some[1]))  # 2 * per_class rows of two numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(picked, "doc_id")

    def terms(batches):
        for part, texts in slices(batches, limit=SLICE):
            doc, bucket = term_pairs(texts)
            key = np.unique(doc * np.int64(1 << BITS) + bucket)
            cut = np.searchsorted(key, np.arange(len(texts) + 1) << BITS)
            blobs = [(key[a:b] & ((1 << BITS) - 1)).astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(blobs, pa.binary())], ["doc_id", "y", "terms"])

    def fitted(batches):
        found = {}
        for b in batches:
            for i, y, blob in zip(*(b.column(c).to_pylist() for c in ("doc_id", "y", "terms"))):
                found[i] = max(found.get(i, (y, b"")), (y, blob))  # of rows that share an id, one
        ids = sorted(found)
        y = np.array([found[i][0] for i in ids], np.int64)
        if y.size and 0 < y.sum() < y.size:
            doc = np.repeat(np.arange(len(ids), dtype=np.int32), [len(found[i][1]) // 4 for i in ids])
            bucket = np.frombuffer(b"".join([found.pop(i)[1] for i in ids]), np.int32)
            model = fit(doc, bucket, y, prior)
            yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})

    got = rows.mapInArrow(terms, "doc_id long, y int, terms binary").repartition(1).mapInArrow(fitted, "model binary").collect()
    return pickle.loads(got[0][0]) if got else constant


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """Every row of ``docs`` with its columns and ``_score``; the score reads the text alone (null: empty)."""
    slot = np.full(1 << BITS, -1, np.int32)
    slot[model["chosen"]] = np.arange(len(model["chosen"]))
    shared = docs.sparkSession.sparkContext.broadcast({**model, "slot": slot})
    names = docs.columns

    def run(batches):
        for rows, texts in slices(batches, limit=SLICE):
            score = predict(shared.value, texts)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in range(len(names))), pa.array(score, pa.float64())], [*names, "_score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_score", T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on), one row per row of ``docs``.

    Equal texts get equal scores; a null doc_id is never held out; an empty table gives no rows.
    """
    out = scored(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def clean_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) that are not predicted toxic."""
    return scored(docs, train(docs, labels)).where("_score < 0.5").select(*docs.columns)

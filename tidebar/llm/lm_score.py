"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is its lower-cased words and one end, its tokens.  A token that occurs in the training
documents is coded in bits: an escape bit, then the first 16 bits of its fingerprint, one decision
each, then its share of the training tokens with the same 16 bits.  Two predictors estimate every
decision from exact counts: all training tokens, and those after the same word before (the
beginning of a text counts as an end).  Other tokens are spelled byte by byte and bit by bit from
the last one to four bytes; those tables are counted over the distinct training words.

Logits are mixed by weights that a gate selects (depth, how often the context was seen, whether it
ever disagreed), and an adaptive table refines the mixed estimate.  What the mixer learns from is a
table of fixed size: how many training decisions have which quantised logits, the decision itself
taken out of its counts.  It is summed over all training tokens, and the online learner runs over
its cells in a fixed order, so a score depends on the documents and never on buckets, batches or
tasks.  Both branches of a decision add up to 1: the probabilities of all known tokens add up to
the share of the escape bit.

Work is done per distinct (word before, 16 bits) pair and per distinct word.  Batches of documents
send sorted lists of both to buckets, buckets count and score them, and the answers go back.  A word
before with more than 1/1024 of all tokens is spread over 256 buckets by the next word's first
bits; its first 8 decisions come from one small table of all such words (1024 times 256 counts at
most).  Words are told apart by 64-bit fingerprints, contexts by 48 bits of them.
"""

from __future__ import annotations

import pickle
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tidebar.llm.textbatch import ASCII_LOWER, Words, mix, single_rows, slices
from tidebar.session import cut_lineage

BATCH = 4 << 20  # bytes of text whose documents share a list of pairs
BUCKET = 5 << 20  # bytes of input text per bucket
DEPTH = 16  # bits of a word's code
HOT = 1024  # a code with more than 1/HOT of all tokens is hot as a word before
TOP = 8  # bits of the next word that spread a hot word
END = mix(np.array([0x454E44], np.uint64))[0]  # fingerprint of the end
PRIOR = 1.0  # weight of the unigram estimate in the estimate after a word
GATES, LEVELS, SPAN = 4 * 2 * 10, 25, 10.0  # of the mixer of codes
SPELL_PRIOR = 0.7  # weight of a shorter context's estimate in the next longer one's
SPELL_GATES = 8 * 7  # of the mixer of spelling
SLOTS = (16, 17, 18, 18)  # bits of the spelling tables, by bytes of context
SPACE = 32
UNIT = 4096.0  # costs of words and codes are whole numbers of 1/UNIT digits
STEP = 33  # cells of the refining table per gate
EPOCHS, PARTS, RATE = 40, 32, 0.03


def _pack(a: np.ndarray) -> bytes:
    """Byte planes, compressed."""
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes(), 3)


def _unpack(blob: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(kind).ravel()


def _pack_sorted(a: np.ndarray) -> bytes:
    return _pack(np.diff(a, prepend=np.uint64(0)))


def _unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpack(blob, np.uint64), dtype=np.uint64)


def squash(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def held_out_ids(ids: list, folds: int = 7, fold: int = 2) -> np.ndarray:
    return np.array([i is not None and zlib.crc32(str(i).encode()) % folds == fold for i in ids], bool)


def _cuts(bucket: np.ndarray):
    """(bucket, first, end) of each run of equal buckets."""
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    return zip(bucket[at].tolist(), at.tolist(), [*at[1:].tolist(), len(bucket)])


def _top(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def _merge(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
    """Distinct keys of a bucket's lists, where each occurs first, their summed counts, and the places of each batch's keys."""
    x = [_unpack_sorted(v) for v in table.column("x").to_pylist()]
    y = [_unpack(v, np.uint32) for v in table.column("y").to_pylist()]
    keys, first, place = np.unique(np.concatenate(x), return_index=True, return_inverse=True)
    counts = np.bincount(place, np.concatenate(y), len(keys)).astype(np.int64)
    places = [_pack(np.diff(p.astype(np.uint32), prepend=np.uint32(0))) for p in np.split(place, np.cumsum([len(v) for v in x])[:-1])]
    row = {
        "bucket": table.column("bucket")[:1].combine_chunks(),
        "x": pa.array([_pack_sorted(keys)], pa.binary()),
        "y": pa.array([_pack(counts)], pa.binary()),
        "batches": pa.array([table.column("batch").to_pylist()], pa.list_(pa.string())),
        "places": pa.array([places], pa.list_(pa.binary())),
    }
    return keys, first, counts, row


# ---- the mixer


class Mixer:
    """Weights per gate and a refining table, learnt from counts of quantised logits.

    Logits point to the branch that was taken, so swapping the branches changes their signs and the
    two estimates of a decision add up to 1.
    """

    def __init__(self, gates: int, inputs: int, levels: int, span: float):
        self.gates, self.inputs, self.levels, self.span = gates, inputs, levels, span
        self.w = np.full((gates, inputs), 1.0 / inputs)
        self.p = np.tile(squash(np.linspace(-8, 8, STEP)), (gates, 1))

    @property
    def size(self) -> int:
        return self.gates * self.levels**self.inputs

    def cell(self, gate: np.ndarray, xs: list[np.ndarray]) -> np.ndarray:
        out = gate.astype(np.int64)
        for x in xs:
            out = out * self.levels + np.rint((np.clip(x, -self.span, self.span) / self.span + 1) * (self.levels - 1) / 2).astype(np.int64)
        return out

    def learn(self, cells: np.ndarray) -> Mixer:
        """Online: part after part of the cells (in a fixed order), adaptive steps."""
        n = cells.reshape(self.gates, -1).astype(float)
        axis = np.linspace(-self.span, self.span, self.levels)
        x = np.stack([g.ravel() for g in np.meshgrid(*[axis] * self.inputs, indexing="ij")], 1)
        order = np.argsort(mix(np.arange(len(x), dtype=np.uint64)))
        mean, square, steps = np.zeros_like(self.w), np.zeros_like(self.w), np.zeros((self.gates, 1))
        usual = np.maximum(n.sum(1, keepdims=True) / PARTS, 1)  # decisions of a gate in one part
        for _ in range(EPOCHS):
            for k in range(PARTS):
                some = order[k::PARTS]
                seen = n[:, some]
                on = (seen.sum(1, keepdims=True) > 0).astype(float)
                grad = (seen * (1 - squash(self.w @ x[some].T))) @ x[some] / usual
                steps += on
                mean, square = np.where(on, 0.9 * mean + 0.1 * grad, mean), np.where(on, 0.99 * square + 0.01 * grad**2, square)
                t = np.maximum(steps, 1)
                move = RATE / np.sqrt(1 + t / 50) * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-6)
                self.w += on * move
        place = np.rint((np.clip(self.w @ x.T, -8, 8) + 8) * (STEP - 1) / 16).astype(np.int64)
        hits = np.bincount((np.arange(self.gates)[:, None] * STEP + place).ravel(), n.ravel(), self.gates * STEP).reshape(-1, STEP)
        self.p = (hits + 20 * squash(np.linspace(-8, 8, STEP))) / (hits + hits[:, ::-1] + 20)
        return self

    def estimate(self, gate: np.ndarray, xs: list[np.ndarray]) -> np.ndarray:
        """Probability of the branch that was taken."""
        w = self.w[gate]
        z = sum(w[:, k] * x for k, x in enumerate(xs))
        at = (np.clip(z, -7.9999, 7.9999) + 8) * (STEP - 1) / 16
        low = at.astype(np.int64)
        part = at - low
        return np.clip((squash(z) + self.p[gate, low] * (1 - part) + self.p[gate, low + 1] * part) / 2, 1e-7, 1 - 1e-7)


# ---- codes of known words


class Counts:
    """Training tokens by code (all prefixes), and those after the hot words by the first TOP bits."""

    def __init__(self, leaves: np.ndarray, tokens: int):
        self.leaves = leaves
        self.order0 = [leaves.reshape(1 << d, -1).sum(1) for d in range(DEPTH + 1)]
        hot = np.flatnonzero(leaves * HOT > tokens)
        self.hot = np.full(1 << DEPTH, -1, np.int32)
        self.hot[hot] = np.arange(len(hot))
        self.after = [np.zeros((len(hot), 1 << d), np.int64) for d in range(TOP + 1)]

    def put_after(self, flat: np.ndarray) -> None:
        table = flat.reshape(-1, 1 << TOP)
        self.after = [table.reshape(len(table), 1 << d, -1).sum(2) for d in range(TOP + 1)]

    @property
    def n_hot(self) -> int:
        return len(self.after[0])

    def hot_of(self, keys: np.ndarray) -> np.ndarray:
        return self.hot[(keys >> np.uint64(48)).astype(np.int64)]

    def route(self, keys: np.ndarray, bits: int) -> np.ndarray:
        next_bits = (keys >> np.uint64(DEPTH - TOP)) & np.uint64((1 << TOP) - 1)
        spread = np.where(self.hot_of(keys) >= 0, next_bits + np.uint64(1), np.uint64(0))
        return _top(mix((keys >> np.uint64(DEPTH)) ^ (spread << np.uint64(48))), bits)


def decisions(keys: np.ndarray, counts: np.ndarray, known: Counts, own: int):
    """(rows, gate, logits) of each depth: rows with a decision to take; ``own`` occurrences of the pair are left out.

    ``keys`` (48 bits of the word before, 16 of the code) are distinct and in order.
    """
    code = (keys & np.uint64((1 << DEPTH) - 1)).astype(np.int64)
    hot = known.hot_of(keys)
    is_hot = np.flatnonzero(hot >= 0)

    def total(d):
        if not len(keys):
            return counts
        start = np.flatnonzero(np.concatenate([[True], np.diff(keys >> np.uint64(DEPTH - d)) != 0]))
        out = np.repeat(np.add.reduceat(counts, start), np.diff(start, append=len(keys)))
        if d <= TOP and len(is_hot):
            out[is_hot] = known.after[d][hot[is_hot], code[is_hot] >> (DEPTH - d)]
        return out

    all1 = total(0)
    for d in range(DEPTH):
        next1 = total(d + 1)
        own0 = known.order0[d + 1][code >> (DEPTH - 1 - d)]
        other0 = known.order0[d][code >> (DEPTH - d)] - own0
        rows = np.flatnonzero((other0 > 0) & (own0 > own))
        a0, b0 = (own0[rows] - own).astype(float), other0[rows].astype(float)
        a1, b1 = next1[rows] - own, (all1 - next1)[rows]
        p0 = a0 / (a0 + b0)
        agrees = ((a1 == 0) | (b1 == 0)).astype(np.int64)
        seen = np.minimum(np.log2(a1 + b1 + 1).astype(np.int64), 9)
        yield rows, (d // 4 * 2 + agrees) * 10 + seen, [np.log(a0 / b0), np.log((a1 + PRIOR * p0) / (b1 + PRIOR * (1 - p0)))]
        all1 = next1


def score_codes(keys: np.ndarray, counts: np.ndarray, known: Counts, mixer: Mixer) -> np.ndarray:
    """Log10 probability of each pair's code after its word before."""
    out = np.zeros(len(keys))
    for rows, gate, xs in decisions(keys, counts, known, 0):
        out[rows] += np.log10(mixer.estimate(gate, xs))
    return out


# ---- spelling of other words


class Spelling:
    """The decisions of some words: one row per byte, the ending space included."""

    def __init__(self, words: list[bytes]):
        size = np.array([len(w) + 1 for w in words], np.int64)
        self.n = len(words)
        self.byte = np.frombuffer(b" ".join(words) + b" ", np.uint8).astype(np.int64)
        self.word = np.repeat(np.arange(self.n), size)
        self.place = np.arange(len(self.byte)) - (np.cumsum(size) - size)[self.word]
        before = []  # the space in front of the word, then zeros
        for k in range(1, len(SLOTS) + 1):
            b = np.full(len(self.byte), SPACE, np.int64)
            b[k:] = self.byte[:-k]
            before.append(np.where(self.place >= k, b, np.where(self.place == k - 1, SPACE, 0)))
        self.keys = [before[0]]
        for b in before[1:]:
            self.keys.append(self.keys[-1] << 8 | b)

    def steps(self):
        """(bit, taken branch, slots in each table) of the eight bits of every byte."""
        for bit in range(8):
            node = (1 << bit) | (self.byte >> (8 - bit))
            slots = [self.keys[0] << 8 | node]
            slots += [(mix((k << 8 | node).astype(np.uint64) + np.uint64(t << 60)) >> np.uint64(64 - SLOTS[t])).astype(np.int64) for t, k in enumerate(self.keys) if t]
            yield bit, (self.byte >> (7 - bit)) & 1, slots

    def inputs(self, tables: list[np.ndarray], own: int):
        """(gate, logits) of the eight bits."""
        for bit, taken, slots in self.steps():
            p, xs = 0.5, []
            for table, s in zip(tables, slots):
                a, b = table[taken, s] - own, table[1 - taken, s]
                p = np.clip((a + SPELL_PRIOR * p) / (a + b + SPELL_PRIOR), 1e-6, 1 - 1e-6)
                xs.append(np.log(p / (1 - p)))
            yield bit * 7 + np.minimum(np.log2(a + b + 1).astype(np.int64), 6), xs[1::2]


def _some_words(words: list[bytes], part: int = 1 << 14):
    for a in range(0, len(words), part):
        yield a, Spelling(words[a : a + part])


def spell(words: list[bytes], tables: list[np.ndarray], mixer: Mixer) -> np.ndarray:
    """Log10 probability of each word's bytes and the space behind them."""
    out = np.zeros(len(words))
    for a, s in _some_words(words):
        for gate, xs in s.inputs(tables, 0):
            out[a : a + s.n] += np.bincount(s.word, np.log10(mixer.estimate(gate, xs)), s.n)
    return out


# ---- batches and buckets

LISTS = "batch string, bucket int, x binary, y binary, z binary"


def _lists(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["batch", "bucket", "x", "y", "z"])


def extract(docs: DataFrame, bits: int, batch: int) -> DataFrame:
    """Per batch its documents as lists of word numbers (bucket -1), and its distinct words by bucket."""

    def run(batches):
        for rows, texts in slices(batches, limit=batch):
            words = Words(texts, ASCII_LOWER)
            ids = rows.column("doc_id").to_pylist()
            held = held_out_ids(ids)
            size = words.counts + 1
            body = np.ones(int(size.sum()), bool)
            body[np.cumsum(size) - 1] = False
            word = np.full(len(body), -1, np.int64)
            word[body] = np.arange(words.n)
            hashes = np.full(len(body), END, np.uint64)
            hashes[body] = words.hashes
            uniq, first, number = np.unique(hashes, return_index=True, return_inverse=True)
            counts = np.bincount(number, np.repeat(~held, size).astype(float), len(uniq)).astype(np.uint32)
            name = uuid.uuid4().hex  # this table is written once, so a number drawn here is fixed
            about = (ids, held, size, np.array([len(t) for t in texts]))
            out = [(name, -1, _pack(number.astype(np.uint32)), zstandard.compress(pickle.dumps(about)), _pack_sorted(uniq))]
            starts, ends, raw = words.starts, words.ends, words.buf.tobytes()
            for b, lo, hi in _cuts(_top(uniq, bits)):
                text = b" ".join([raw[starts[i] : ends[i]] if i >= 0 else b"" for i in word[first[lo:hi]].tolist()])
                out.append((name, b, _pack_sorted(uniq[lo:hi]), _pack(counts[lo:hi]), zstandard.compress(text, 3)))
            yield _lists(out)

    return docs.mapInArrow(run, LISTS)


def pairs_of(x: bytes, y: bytes, z: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of a batch in order, the pair of each token, and training counts."""
    number, hashes = _unpack(x, np.uint32).astype(np.int64), _unpack_sorted(z)
    _, held, size, _ = pickle.loads(zstandard.decompress(y))
    token = hashes[number]
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[np.cumsum(size) - size] = END
    keys, pair = np.unique((before & ~np.uint64(0xFFFF)) | (token >> np.uint64(48)), return_inverse=True)
    return keys, pair, np.bincount(pair, np.repeat(~held, size).astype(float), len(keys)).astype(np.uint32)


MERGED = "bucket int, x binary, y binary, batches array<string>, places array<binary>"


def count_words(table: pa.Table) -> pa.Table:
    """Distinct words of a bucket in order of fingerprints, with their training counts."""
    words: list[bytes] = []
    for t in table.column("z").to_pylist():
        words += zstandard.decompress(t).split(b" ")
    keys, first, counts, row = _merge(table)
    codes, at = np.unique(keys >> np.uint64(48), return_inverse=True)
    leaves = (codes.astype(np.int64), np.bincount(at, counts, len(codes)).astype(np.int64))
    row["z"] = pa.array([zstandard.compress(b" ".join([words[i] for i in first.tolist()]), 3)], pa.binary())
    row["codes"] = pa.array([pickle.dumps(leaves)], pa.binary())
    numbers = {"tokens": counts.sum(), "words": (counts > 0).sum(), "single": (counts == 1).sum()}
    return pa.table(row | {k: pa.array([int(v)], pa.int64()) for k, v in numbers.items()})


def count_pairs(table: pa.Table) -> pa.Table:
    return pa.table(_merge(table)[3])


def _answers(row: dict, kind: int, values: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """What each batch asked of a bucket: costs in 1/UNIT digits, and counts of words."""
    cost = np.rint(-values * UNIT).astype(np.uint32)
    at = [np.cumsum(_unpack(p, np.uint32), dtype=np.uint32) for p in row["places"]]
    n = len(at)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(row["batches"], pa.string()),
            pa.array([kind] * n, pa.int32()),
            pa.array([row["bucket"]] * n, pa.int32()),
            pa.array([_pack(cost[a]) for a in at], pa.binary()),
            pa.array([_pack(counts[a].astype(np.uint32)) if kind == 0 else None for a in at], pa.binary()),
        ],
        ["batch", "kind", "bucket", "x", "y"],
    )


def summed(df: DataFrame, cells_of, size: int) -> np.ndarray:
    """Sums of (cell, count) arrays over all rows: ``size`` numbers, whatever the rows (no counts: each cell is one)."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for row in single_rows(batches):
            for cell, n in cells_of(row):
                np.add.at(total, cell, 1 if n is None else n)
        at = np.flatnonzero(total)
        for a in range(0, len(at), 1 << 16):
            some = at[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["cell", "n"])

    found = df.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out


def lm_scores(docs: DataFrame, batch: int = BATCH, bucket: int = BUCKET) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10), bits_per_byte.

    Learns from documents outside the held-out fold (crc32 of doc_id mod 7 is 2), scores all.
    ``base_score`` is the add-one unigram log10 probability, ``score`` the mixed model's, and
    ``bits_per_byte`` its bits over the text's UTF-8 bytes (null without any).  Null and empty texts
    are one end; a null doc_id is never held out; repeats of a row count each time.  With nothing to
    learn from, N and V are 0 and every estimate starts from its prior.  One row per row of
    ``docs``; an empty table gives none; other columns are ignored.  Scores do not depend on
    ``batch`` and ``bucket``.
    """
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, (max(1, size // bucket) - 1).bit_length())
    word_bits = min(bits, DEPTH)
    written = cut_lineage(extract(rows, word_bits, batch))
    texts = written.where("bucket < 0")

    # words: counts, codes, spelling
    word_lists = written.where("bucket >= 0")
    kinds = MERGED + ", z binary, codes binary, tokens long, words long, single long"
    words = cut_lineage(word_lists.groupBy("bucket").applyInArrow(count_words, kinds))
    tokens, vocabulary, single = words.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "words", "single")]).first()
    leaves = np.zeros(1 << DEPTH, np.int64)
    for r in words.select("codes").toLocalIterator():  # 2^16 counts in all
        codes, n = pickle.loads(r.codes)
        leaves[codes] = n
    known = Counts(leaves, tokens)
    escape = (single + 0.5) / (tokens + 1)
    base = [0, *np.cumsum([2 << s for s in SLOTS]).tolist()]

    def trained(row):
        seen = _unpack(row["y"], np.int64) > 0
        return [w for w, s in zip(zstandard.decompress(row["z"]).split(b" "), seen.tolist()) if s]

    def spelling_counts(row):
        for _, s in _some_words(trained(row)):
            for _, taken, slots in s.steps():
                for t, at in enumerate(slots):
                    yield (taken << SLOTS[t]) + at + base[t], None

    flat = summed(words.select("y", "z"), spelling_counts, base[-1])
    tables = share([flat[a:b].reshape(2, -1) for a, b in zip(base, base[1:])])
    speller = Mixer(SPELL_GATES, 2, LEVELS, SPAN)

    def spelling_cells(row):
        for _, s in _some_words(trained(row)):
            for gate, xs in s.inputs(tables.value, 1):
                yield speller.cell(gate, xs), None

    speller = share(speller.learn(summed(words.select("y", "z"), spelling_cells, speller.size)))

    # pairs: counts after a word
    routes = share(known)

    def list_pairs(batches):
        for row in single_rows(batches):
            keys, _, counts = pairs_of(row["x"], row["y"], row["z"])
            route = routes.value.route(keys, bits)
            order = np.argsort(route, kind="stable")
            out = [(row["batch"], b, _pack_sorted(keys[order[lo:hi]]), _pack(counts[order[lo:hi]]), None) for b, lo, hi in _cuts(route[order])]
            yield _lists(out)

    def hot_cells(row):
        keys, counts = _unpack_sorted(row["x"]), _unpack(row["y"], np.int64)
        hot = routes.value.hot_of(keys).astype(np.int64)
        on = hot >= 0
        yield (hot[on] << TOP) | ((keys[on] >> np.uint64(DEPTH - TOP)) & np.uint64((1 << TOP) - 1)).astype(np.int64), counts[on]

    pairs = cut_lineage(texts.mapInArrow(list_pairs, LISTS).drop("z").groupBy("bucket").applyInArrow(count_pairs, MERGED))
    if known.n_hot:
        known.put_after(summed(pairs.select("x", "y"), hot_cells, known.n_hot << TOP))
    model = share(known)
    mixer = Mixer(GATES, 2, LEVELS, SPAN)

    def code_cells(row):
        keys, counts = _unpack_sorted(row["x"]), _unpack(row["y"], np.int64)
        keys, counts = keys[counts > 0], counts[counts > 0]
        # a token alone with its code would be spelled if it were left out
        leaf = model.value.leaves[(keys & np.uint64(0xFFFF)).astype(np.int64)]
        learnt = np.where(leaf > 1, counts, 0)
        for at, gate, xs in decisions(keys, counts, model.value, 1):
            on = learnt[at] > 0
            yield mixer.cell(gate[on], [x[on] for x in xs]), learnt[at][on]

    coder = share(mixer.learn(summed(pairs.select("x", "y"), code_cells, mixer.size)))

    # answers
    def answer_words(batches):
        for row in single_rows(batches):
            keys, counts, text = _unpack_sorted(row["x"]), _unpack(row["y"], np.int64), zstandard.decompress(row["z"]).split(b" ")
            leaf = model.value.leaves[(keys >> np.uint64(48)).astype(np.int64)]
            values = np.log10(np.maximum(counts, 1) / np.maximum(leaf, 1)) + np.log10(1 - escape)
            new = np.flatnonzero(counts == 0)
            values[new] = spell([text[i] for i in new.tolist()], tables.value, speller.value) + np.log10(escape)
            yield _answers(row, 0, values, counts)

    def answer_pairs(batches):
        for row in single_rows(batches):
            keys, counts = _unpack_sorted(row["x"]), _unpack(row["y"], np.int64)
            yield _answers(row, 1, score_codes(keys, counts, model.value, coder.value), counts)

    back, columns = "batch string, kind int, bucket int, x binary, y binary", ["bucket", "x", "y", "batches", "places"]
    answers = words.select(*columns, "z").mapInArrow(answer_words, back).unionByName(pairs.select(columns).mapInArrow(answer_pairs, back))

    def finished(documents: pa.Table, found: pa.Table) -> pa.Table:
        row = documents.to_pylist()[0]
        number = _unpack(row["x"], np.uint32).astype(np.int64)
        ids, held, n_tokens, n_bytes = pickle.loads(zstandard.decompress(row["y"]))
        parts: list[list] = [[], []]
        for r in sorted(found.to_pylist(), key=lambda r: r["bucket"]):
            parts[r["kind"]].append(r)
        word_value = np.concatenate([_unpack(r["x"], np.uint32) for r in parts[0]]) / -UNIT
        seen = np.concatenate([_unpack(r["y"], np.uint32) for r in parts[0]]).astype(np.int64)
        keys, pair, _ = pairs_of(row["x"], row["y"], row["z"])
        code_value = np.empty(len(keys))
        code_value[np.argsort(routes.value.route(keys, bits), kind="stable")] = np.concatenate([_unpack(r["x"], np.uint32) for r in parts[1]]) / -UNIT
        token = word_value[number] + np.where(seen[number] > 0, code_value[pair], 0)
        first = np.cumsum(n_tokens) - n_tokens
        score = np.add.reduceat(token, first)
        per_byte = [-s / np.log10(2) / n if n else None for s, n in zip(score.tolist(), n_bytes.tolist())]
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64()),
                "held_out": pa.array(held, pa.bool_()),
                "n_tokens": pa.array(n_tokens, pa.int64()),
                "n_known": pa.array(np.add.reduceat((seen > 0)[number].astype(np.int64), first), pa.int64()),
                "train_tokens": pa.array(np.full(len(n_tokens), tokens), pa.int64()),
                "base_score": pa.array(np.add.reduceat(np.log10((seen + 1) / (tokens + vocabulary + 1))[number], first), pa.float64()),
                "score": pa.array(score, pa.float64()),
                "bits_per_byte": pa.array(per_byte, pa.float64()),
            }
        )

    result = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return texts.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(finished, result)

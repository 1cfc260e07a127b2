import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidebar.llm import lm_score as lm
from tidebar.llm.lm_score import lm_scores
from tidebar.llm.queries import QUERIES
from tidebar.llm.textbatch import single_rows, word_hashes


def words_of(t):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def base(rows):
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter()
    for i, t in rows:
        if not out(i):
            counts.update([*words_of(t), None])
    n, v = sum(counts.values()), len(counts)
    res = []
    for i, t in rows:
        tokens = [*words_of(t), None]
        res.append((i, out(i), len(tokens), sum(counts[x] > 0 for x in tokens), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens), 6)))
    return sorted(res, key=repr)


def test_base_and_edges(docs_of):
    rows = [(i, f"Some words {i % 5} and\tmore éÉ " * (i % 4)) for i in range(40)] + [(41, None), (42, ""), (None, "Words words"), (1, "words"), (1, "words"), (43, "y" * 3000), (44, "pad " * 5000)]
    got = lm_scores(docs_of(rows), batch=2000, bucket=1000).collect()
    assert sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got], key=repr) == base(rows)
    assert all(r.score < 0 for r in got)
    assert lm_scores(docs_of([])).count() == 0


def fitted(rng, gates):
    cells = rng.integers(0, 50, gates * lm.LEVELS**2)
    return lm.Mixer(gates, 2, lm.LEVELS, lm.SPAN).learn(cells)


def test_codes_add_up():
    rng = np.random.default_rng(3)
    codes = np.sort(rng.choice(1 << lm.DEPTH, 300, replace=False))
    leaves = np.zeros(1 << lm.DEPTH, np.int64)
    leaves[codes] = rng.integers(1, 9, 300)
    known = lm.Counts(leaves, 10**9)
    keys = (np.uint64(0x123456789ABC) << np.uint64(16)) | codes.astype(np.uint64)
    score = lm.score_codes(keys, rng.integers(0, 4, 300), known, fitted(rng, lm.GATES))
    assert abs((10**score).sum() - 1) < 1e-6


def test_spellings_add_up():
    # the byte after "abc" is one of 256, the space that ends the word among them
    rng = np.random.default_rng(4)
    tables = [rng.integers(0, 9, (2, 1 << s)) for s in lm.SLOTS]
    mixer = fitted(rng, lm.SPELL_GATES)
    words = [b"abc" + bytes([x]) for x in range(256) if x != 32] + [b"abc"]
    s = lm.Spelling(words)
    total = np.zeros(len(words))
    for gate, xs in s.inputs(tables, 0):
        total += np.log(mixer.estimate(gate, xs)[s.place == 3])
    assert abs(np.exp(total).sum() - 1) < 1e-6


def plain_scores(rows):
    """Token by token from dictionaries; hashes, the mixer and the spelling are the operator's."""
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2

    def hash_of(w):
        return int(lm.END) if w is None else int(word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]))[0])

    bits = lambda h: format(h >> 48, "016b")
    count, order0, after, texts = Counter(), Counter(), Counter(), []
    pairs = Counter()
    for i, t in rows:
        tokens = [*words_of(t), None]
        texts.append(tokens)
        for before, w in zip([None, *tokens], tokens):
            if not out(i):
                count[w] += 1
                pairs[hash_of(before), bits(hash_of(w))] += 1
                for d in range(17):
                    order0[bits(hash_of(w))[:d]] += 1
    n = order0[""]
    hot = lambda h: order0[bits(h)] * lm.HOT > n
    for (before, code), c in pairs.items():
        for d in range(17):
            # a hot word's first bits are counted by its code
            after[bits(before) if hot(before) and d <= lm.TOP else before, code[:d]] += c

    def steps(before, code, own):
        for d in range(16):
            other = code[:d] + str(1 - int(code[d]))
            a0, b0 = order0[code[: d + 1]] - own, order0[other]
            if b0 > 0 and a0 > 0:
                total = after[bits(before) if hot(before) and d <= lm.TOP else before, code[:d]]
                taken = after[bits(before) if hot(before) and d + 1 <= lm.TOP else before, code[: d + 1]]
                a1, b1 = taken - own, total - taken
                p0 = a0 / (a0 + b0)
                gate = (d // 4 * 2 + (a1 == 0 or b1 == 0)) * 10 + min(int(math.log2(a1 + b1 + 1)), 9)
                yield np.array([gate]), [np.array([math.log(a0 / b0)]), np.array([math.log((a1 + lm.PRIOR * p0) / (b1 + lm.PRIOR * (1 - p0)))])]

    mixer = lm.Mixer(lm.GATES, 2, lm.LEVELS, lm.SPAN)
    cells = np.zeros(mixer.size, np.int64)
    for (before, code), c in pairs.items():
        if order0[code] > 1:
            for gate, xs in steps(before, code, 1):
                cells[mixer.cell(gate, xs)] += c
    mixer.learn(cells)
    trained = lm.Spelling([b"" if w is None else w.encode() for w in count])
    tables = [np.zeros((2, 1 << s), np.int64) for s in lm.SLOTS]
    for _, taken, slots in trained.steps():
        for table, at in zip(tables, slots):
            np.add.at(table, (taken, at), 1)
    speller = lm.Mixer(lm.SPELL_GATES, 2, lm.LEVELS, lm.SPAN)
    cells = np.zeros(speller.size, np.int64)
    for gate, xs in trained.inputs(tables, 1):
        np.add.at(cells, speller.cell(gate, xs), 1)
    speller.learn(cells)
    escape = (sum(c == 1 for c in count.values()) + 0.5) / (n + 1)
    res = []
    for (i, _), tokens in zip(rows, texts):
        score = 0.0
        for before, w in zip([None, *tokens], tokens):
            if count[w]:
                code = bits(hash_of(w))
                score += math.log10((1 - escape) * count[w] / order0[code])
                score += sum(math.log10(mixer.estimate(gate, xs)[0]) for gate, xs in steps(hash_of(before), code, 0))
            else:
                score += math.log10(escape) + lm.spell([b"" if w is None else w.encode()], tables, speller)[0]
        res.append((i, score))
    return res


@pytest.mark.parametrize("hot", [1024, 15])  # every word before is hot, few are
def test_plain_version(docs_of, monkeypatch, hot):
    monkeypatch.setattr(lm, "HOT", hot)
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)] + ["the"] * 30 + ["É", "x" * 40]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 40)))) for i in range(60)] + [(60, None), (61, "wholly new words"), (2, "new new"), (None, "the the")]
    got = sorted(((r.doc_id, r.score) for r in lm_scores(docs_of(rows), batch=700, bucket=500).collect()), key=repr)
    want = sorted(plain_scores(rows), key=repr)
    assert [g[0] for g in got] == [w[0] for w in want]
    # each of a text's at most 41 tokens is rounded twice, to 1/4096 digit
    assert max(abs(g[1] - w[1]) for g, w in zip(got, want)) < 41 / lm.UNIT


def test_scores_do_not_depend_on_the_layout(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a = {r.doc_id: r.score for r in lm_scores(docs).collect()}
    b = {r.doc_id: r.score for r in lm_scores(docs.repartition(5), batch=50_000, bucket=20_000).collect()}
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-6


def test_held_out_documents(spark):
    got = QUERIES["op7_lm_scoring"](spark, "/root/testdata/sf0.01").where("held_out")
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = got.join(texts, "doc_id").collect()
    # the base is no distribution over spellings and pays nothing for unknown words; where it knows
    # every word, the words before make the model better
    known = [r for r in rows if r.n_known == r.n_tokens]
    assert len(known) > 5 and sum(r.score for r in known) > 0.75 * sum(r.base_score for r in known)
    assert sum(r.score > r.base_score for r in known) > 0.8 * len(known)
    for r in rows:
        n = len((r.text or "").encode())
        assert r.bits_per_byte is None if n == 0 else abs(r.bits_per_byte + r.score / math.log10(2) / n) < 1e-9


def test_spelling_memory():
    # 60000 words with half a million bytes are spelled in small parts
    rng = np.random.default_rng(5)
    tables = [rng.integers(0, 9, (2, 1 << s)) for s in lm.SLOTS]
    mixer = fitted(rng, lm.SPELL_GATES)
    words = [b"w%07d" % i for i in range(60_000)]
    tracemalloc.start()
    values = lm.spell(words, tables, mixer)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 and (values[50_000:50_100] == lm.spell(words[50_000:50_100], tables, mixer)).all()


def test_large_rows_come_one_by_one():
    batch = pa.RecordBatch.from_pydict({"x": [bytes(1 << 20)] * 20 + [None]})
    tracemalloc.start()
    sizes = [len(row["x"] or b"") for row in single_rows([batch, batch.slice(0, 0)])]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sizes == [1 << 20] * 20 + [0] and peak < 5e6

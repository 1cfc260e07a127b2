import random
import re

import numpy as np
import pytest

from tidebar.llm.anchors import sliding_min
from tidebar.llm.substring_dedup import repeats, substring_dedup
from tidebar.llm.textbatch import Words, ngram_hashes


def brute(rows, window):
    split = [(i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    big = float("inf")
    least = {}
    for i, w in split:
        for a in range(len(w) - window + 1):
            s = tuple(w[a : a + window])
            least[s] = min(least.get(s, big), big if i is None else i)
    out = []
    for i, w in split:
        gone = set()
        for a in range(len(w) - window + 1):
            if least[tuple(w[a : a + window])] < (big if i is None else i):
                gone.update(range(a, a + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 3)))
    parts = [[word() for _ in range(rng.choice([5, 12, 30]))] for _ in range(12)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += rng.choice(parts) if rng.random() < 0.6 else [word() for _ in range(rng.randint(1, 20))]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(w)))
    rows += [(60, None), (61, ""), (62, rows[3][1]), (3, rows[3][1]), (5, rows[9][1]), (None, rows[4][1]), (None, rows[4][1]), (63, "x " * 3000), (64, "x " * 3000), (65, rows[7][1].upper())]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,batch,leads", [(1, 1 << 20, 100000), (2, 300, 100000), (3, 300, 1)])
def test_brute_force(docs_of, seed, batch, leads):
    rows = corpus(seed)
    got = substring_dedup(docs_of(rows), window=10, gram=3, batch=batch, bucket=500, leads=leads)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == sorted(brute(rows, 10), key=repr)


def test_equal_fingerprints_are_checked():
    words = Words([b"a b c d e f", b"a b c d x y", b"a b c d e f"])
    at = np.flatnonzero(words.left >= 4)
    lying = np.zeros(len(at), np.uint64)  # one fingerprint for everything
    got = repeats(words, at, lying, np.array([1, 2, 3])[words.doc[at]], 4)
    assert got.tolist() == [False] * 3 + [True, False, False] + [True] * 3


def test_hashes():
    words = Words([b"a bb c a bb c", b"", b"bb c", b"\xc3\xa9"])
    assert words.counts.tolist() == [6, 0, 2, 1] and words.word(1) == b"bb"
    h = words.hashes
    assert h[0] == h[3] and h[1] == h[4] == h[6] and len({int(x) for x in h}) == 4
    two = ngram_hashes(h, 2)
    assert two[0] == two[3] and two[1] == two[4] == two[6] and two[0] != two[1]
    for k in (1, 3, 7, 50):
        for n in (0, 1, 5, 200):
            assert len(ngram_hashes(np.arange(n, dtype=np.uint64), k)) == n
    v = np.random.default_rng(1).integers(0, 1000, 300)
    assert all(sliding_min(v, 47)[i] == v[i : i + 47].min() for i in range(300))


def test_empty(docs_of):
    assert substring_dedup(docs_of([])).count() == 0


def test_oracle(same_as_oracle):
    assert same_as_oracle("op1_substring_dedup")

import random

import numpy as np
import pytest

from tidebar.llm.suffix_dedup import DiskQueue, between, earlier, pack_meta, range_min, repeated, suffix_dedup, unpack_meta


def brute(rows, window):
    big = float("inf")
    data = [(big if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, t in sorted(set(data)):  # distinct ids here, but for whole repeated rows
        for a in range(len(t) - window + 1):
            s = t[a : a + window]
            first[s] = min(first.get(s, (big, big)), (i, a))
    out = []
    for (i, t), (d, _) in zip(data, rows):
        gone = np.zeros(len(t), bool)
        for a in range(len(t) - window + 1):
            if first[t[a : a + window]] < (i, a):
                gone[a : a + window] = True
        spans = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]]))).reshape(-1, 2)
        out.append((d, len(t), tuple(map(tuple, spans.tolist())), bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


def corpus(seed):
    rng = random.Random(seed)
    part = lambda n: "".join(rng.choice("ab é\n\0c") for _ in range(n))
    parts = [part(rng.choice([10, 20, 45, 80])) for _ in range(14)]
    rows = []
    for i in range(50):
        rows.append((i, "".join(rng.choice(parts) if rng.random() < 0.6 else part(rng.randint(1, 40)) for _ in range(rng.randint(0, 5)))))
    rows += [(60, None), (61, ""), (62, rows[3][1]), (63, "z" * 900), (64, "z" * 31), (65, "yz" * 300), (66, rows[8][1] * 3), (66, rows[8][1] * 3), (None, rows[9][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,batch,bucket,queue,leads", [(1, 1 << 20, 1 << 20, 1000, 100000), (2, 400, 900, 7, 100000), (3, 300, 1 << 20, 50, 1), (4, 100, 2000, 3, 100000)])
def test_brute_force(docs_of, seed, batch, bucket, queue, leads):
    rows = corpus(seed)
    got = suffix_dedup(docs_of(rows), window=24, gram=6, batch=batch, bucket=bucket, queue=queue, leads=leads, together=queue)
    got = [(r.doc_id, r.n_bytes, tuple((s.first, s.end) for s in r.spans), bytes(r.kept)) for r in got.collect()]
    assert sorted(got, key=repr) == sorted(brute(rows, 24), key=repr)


def test_queue_on_disk():
    rng = random.Random(1)
    items = [(bytes(rng.randrange(3) for _ in range(rng.randrange(6))), i) for i in range(5000)]
    q = DiskQueue(700)
    for i in range(0, len(items), 90):
        q.push(items[i : i + 90])
    assert len(q.files) > 3 and [x[0] for x in q.drain()] == sorted(x[0] for x in items)
    assert list(q.drain()) == []


def test_helpers():
    v = np.random.default_rng(3).integers(0, 99, 200).astype(np.uint8)
    at = np.array([0, 3, 4, 90, 199])
    assert between(v, at).tolist() == [0, v[1:4].min(), v[4], v[5:91].min(), v[91:200].min()]
    low, high = np.array([0, 5, 7, 100]), np.array([199, 5, 90, 101])
    assert range_min(v, low, high).tolist() == [v[a : b + 1].min() for a, b in zip(low, high)]
    # one fingerprint for different strings: the bytes decide
    data, where = b"abcabdabc", np.arange(7)
    assert earlier(data, where, np.zeros(7, np.uint64), 3).tolist() == [data[a : a + 3] in [data[b : b + 3] for b in range(a)] for a in range(7)]


def test_default_windows(docs_of):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    shared = text(99), text(100), text(700)
    rows = [(i, text(150) + shared[i % 3] + text(60)) for i in range(9)]
    got = [(r.doc_id, r.n_bytes, tuple((s.first, s.end) for s in r.spans), bytes(r.kept)) for r in suffix_dedup(docs_of(rows)).collect()]
    assert sorted(got) == sorted(brute(rows, 100))
    assert suffix_dedup(docs_of([])).count() == 0


def test_meta_round_trip():
    rng = np.random.default_rng(2)
    for rows in (1, 2, 500):
        doc = np.sort(rng.integers(-3, rows, rows))
        meta = np.stack([doc, doc * -(2**61), *rng.integers(0, 2**40, (3, rows))], axis=1)
        assert (unpack_meta(pack_meta(meta)) == meta).all()


def test_repeated_keys():
    rng = np.random.default_rng(3)
    for most in (1, 5, 1000, 2**64 - 1):
        key = rng.integers(0, most, 700, np.uint64, endpoint=True)
        values, counts = np.unique(key, return_counts=True)
        assert repeated(key).tolist() == np.flatnonzero(np.isin(key, values[counts > 1])).tolist()
    assert not len(repeated(np.zeros(0, np.uint64)))

import random
import re

import numpy as np
import pytest

from tidebar.llm.circulant_minhash import circulant_components, least_agreement, ranks, signatures


def shingles(text, k=3):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, share=85):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            both = len(s & sets[j])
            if s and sets[j] and 100 * both >= share * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if sets[i] and d is not None:
            r = find(i)
            least[r] = min(least.get(r, d), d)
    out = [(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]
    return sorted(((*r, r[0] == r[2]) for r in out), key=str)


def corpus(seed, families=10, most=40):
    """Families of near copies around the wanted similarity, chains, a line that most documents share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    line = [word() for _ in range(14)]
    texts = []
    for _ in range(families):
        base = [word() for _ in range(rng.choice([6, 20, 60, 150]))]
        for _ in range(rng.choice([1, 2, 3, most])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                t[rng.randrange(len(t))] = word()
            if rng.random() < 0.2:
                base = t  # drift: chains of links
            texts.append(" ".join((line if rng.random() < 0.6 else []) + t))
    texts += [None, "", " \n", "one", "ONE", "two words", "two  words", "a b c", texts[0], texts[0].upper(), "pad " * 400, "pad " * 9000]
    rng.shuffle(texts)
    return list(enumerate(texts))


def run(docs_of, rows, **kw):
    out = circulant_components(docs_of(rows), **kw)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted(map(tuple, out.collect()), key=str)


def test_second_permutation_is_one():
    x = np.arange(1 << 16, dtype=np.uint32) * np.uint32(65537)
    assert len(np.unique(ranks(x))) == 1 << 16


def test_estimates():
    """Agreement of the coordinates estimates the similarity."""
    rng = np.random.default_rng(1)
    for j in (0.2, 0.5, 0.85):
        errors = []
        for _ in range(30):
            pool = rng.integers(0, 1 << 63, 400).astype(np.uint64)
            both = int(400 * j)
            rest = (400 - both) // 2
            a, b = signatures([np.unique(pool[: both + rest]), np.unique(np.concatenate([pool[:both], pool[both + rest :]]))], 96)
            errors.append((a == b).mean() - both / 400)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.07
    assert 45 < least_agreement(96, 85) < 60


@pytest.mark.parametrize("kw", [{}, {"long": 3, "side": 4, "tile": 6, "heavy": 5}])
def test_like_brute_force(docs_of, kw):
    """With tiny bounds all ways are taken: hubs, tiles, dealt buckets."""
    rows = corpus(4)
    assert run(docs_of, rows, **kw) == brute(rows)


def test_crowd_below_the_similarity(docs_of):
    """One base, many copies that differ in as many words as the bound allows: some linked, some alone."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(150):
        t = list(base)
        for x in rng.sample(range(90), rng.choice([1, 2, 3, 4, 5, 6])):
            t[x] = f"x{rng.randrange(10**6)}"
        rows.append((i + 1, " ".join(t)))
    assert run(docs_of, rows, long=4, side=8, tile=16) == brute(rows)


def test_repeats_nulls_and_shared_ids(docs_of):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words stand in here"), (2, "A B C D E F"), (None, "a b c d e f"), (None, "x y z"), (3, None), (None, None), (4, "x y z"), (5, "")]
    assert run(docs_of, rows) == brute(rows)
    assert run(docs_of, []) == []


def test_third_are_copies(docs_of):
    rows = [(i, "the same text stands here again and again" if i % 3 == 0 else f"text number {i} with words {i * 7} of its {i * 13} own") for i in range(300)]
    assert run(docs_of, rows, heavy=20) == brute(rows)


def test_very_long(docs_of):
    long = " ".join(f"w{i}" for i in range(120_000))
    rows = [(1, long), (2, long + " tail of three"), (3, long[: len(long) // 2]), (4, "short")]
    assert [r[2] for r in run(docs_of, rows)] == [1, 1, 3, 4]


def test_query(same_as_oracle):
    assert len(same_as_oracle("op11_circulant_minhash")) > 100

import random
import re

import numpy as np
import pytest

from tidebar.llm import jaccard_join
from tidebar.llm.components import components
from tidebar.llm.jaccard_join import bitmap, jaccard_components, representatives


def shingles(text, k=5):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in where[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if sets[i] and d is not None:
            r = find(i)
            least[r] = min(least.get(r, d), d)
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def corpus(seed, families=14, common=True):
    """Families of near copies of several sizes, chains, a line that most documents share, repeats."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    line = [word() for _ in range(14)]
    texts = []
    for f in range(families):
        base = [word() for _ in range(rng.choice([6, 20, 60, 150]))]
        for _ in range(rng.choice([1, 2, 3, 40])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                t[rng.randrange(len(t))] = word()
            if rng.random() < 0.2:
                base = t  # drift: chains of links
            texts.append(" ".join((line if common and rng.random() < 0.6 else []) + t))
    texts += [None, "", " \n", "one", "ONE", "two words", "two  words", "a b c d", texts[0], texts[0].upper(), "pad " * 400, "pad " * 9000]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,least,most,frequent", [(1, 16, 16, 4000000), (2, 4, 2, 4000000), (3, 2, 5, 60), (4, 1000, 1, 10)])
def test_brute_force(docs_of, seed, least, most, frequent):
    rows = corpus(seed)
    got = jaccard_components(docs_of(rows), least_df=least, bucket=20000, most=most, frequent=frequent)
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute(rows))


def test_small_tiles(docs_of):
    rows = corpus(6, families=10)
    got = jaccard_components(docs_of(rows), least_df=2, bucket=20000, most=2, side=3, tile=7)
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute(rows))


def test_bitmap_never_exceeds_the_difference():
    rng = np.random.default_rng(1)
    for size in (1, 30, 500, 9000):
        a = rng.integers(0, 2**63, size, np.uint64)
        b = np.unique(np.concatenate([a[size // 4 :], rng.integers(0, 2**63, size // 5, np.uint64)]))
        a = np.unique(a)
        differ = int(np.bitwise_count(np.frombuffer(bitmap(a), np.uint64) ^ np.frombuffer(bitmap(b), np.uint64)).sum())
        assert differ <= len(np.setxor1d(a, b))


def test_unlike_documents_with_a_common_line(docs_of, monkeypatch):
    # a line as long as a prefix, too short for a link, in 600 unlike documents and 40 near copies
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    line, base = [word() for _ in range(34)], [word() for _ in range(30)]
    rows = [(i, " ".join(line + [word() for _ in range(30)])) for i in range(600)]
    rows += [(600 + i, " ".join(line + base[:-1] + [word()])) for i in range(40)]
    asked, plain = [], jaccard_join.similar

    def counted(pairs, *rest):
        asked.append(pairs.count())
        return plain(pairs, *rest)

    monkeypatch.setattr(jaccard_join, "similar", counted)
    got = {r.doc_id: r.component_id for r in jaccard_components(docs_of(rows), least_df=2).collect()}
    assert got == {i: min(i, 600) for i in range(640)}
    assert sum(asked) < 20 * len(rows)  # 179 700 pairs of unlike documents share the line


def test_ids(docs_of):
    text = "some words that are long enough to count here"
    rows = [(None, text), (7, text), (5, text + " more"), (5, "other text of six words only"), (None, "quite different words without any copy here"), (9, None), (5, text + " more")]
    got = jaccard_components(docs_of(rows))
    assert sorted([tuple(r) for r in got.collect()], key=repr) == sorted(brute(rows), key=repr)
    kept = representatives(docs_of([(i, t) for i, t in rows if i is not None]))
    assert kept.columns == docs_of(rows).columns
    assert sorted([(r.doc_id, (r.text or "")[:5]) for r in kept.collect()]) == [(5, "other"), (5, "some "), (9, "")]
    assert jaccard_components(docs_of([])).count() == 0


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(200, i) for i in range(201, 260)] + [(7, 7)]
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for n in sorted(near):
        if n in want or near[n] == {n}:
            continue
        todo = [n]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = n
                todo += near[x]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want


def test_query_like_its_sql(same_as_oracle):
    assert len(same_as_oracle("op10_ngram_jaccard_join")) > 100

import re

from tidebar.llm.decontaminate import contamination, digest

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(docs, items, window=10):
    runs = []
    for i, t in items:
        w = WORD.findall(lower(t))
        k = min(window, len(w))
        runs += [(i, w[a : a + k]) for a in range(len(w) - k + 1)] if w else []
    out = []
    for i, t in docs:
        w, hit, ids = WORD.findall(lower(t)), set(), set()
        for item, r in runs:
            for a in range(len(w) - len(r) + 1):
                if w[a : a + len(r)] == r:
                    hit.update(range(a, a + len(r)))
                    ids.add(item)
        ids.discard(None)
        out.append((i, len(w), len(hit), len(ids), bool(hit)))
    return out


def test_brute_force(spark, docs_of):
    passage = " ".join(f"word{i}" for i in range(25))
    items = [(1, passage), (2, "One, two three"), (3, None), (4, "--"), (5, "éa"), (5, "x1"), (None, "lost item"), (2, "one two THREE"), (6, "a a a a a a a a a a a")]
    docs = [
        (1, "start " + passage.upper() + " end"), (2, " ".join(f"word{i}" for i in range(9))), (3, "one two"), (4, None), (5, "...one--two\nthree four"),
        (6, "one two"), (7, "three one two three"), (8, "ÉA éa x1 x11"), (9, "the lost item " * 3), (10, "a " * 40), (11, ""), (12, passage + " " + "pad " * 5000 + passage), (12, "again x1"), (None, "x1"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for block in (1 << 20, 60):  # one block and several
        got = digest(contamination(docs_of(docs), bench, block_bytes=block)).collect()
        assert sorted([(r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got], key=repr) == sorted(want, key=repr)


def test_empty(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in digest(contamination(docs_of([(1, "a b")]), none)).collect()] == [0]
    assert contamination(docs_of([]), none).count() == 0


def test_oracle(same_as_oracle):
    assert any(r[0] for r in same_as_oracle("op2_benchmark_decontamination"))

import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.llm import toxicity as toxicity_module
from tidebar.llm.queries import QUERIES
from tidebar.llm.toxicity import clean_rows, fit, term_pairs, toxicity


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_held_out(spark, sf):
    got = QUERIES["op3_toxicity"](spark, sf)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = got.collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    test = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    pos, neg = [s for s, y in test if y], [s for s, y in test if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    print("auc", auc, "wrong", sum((s >= 0.5) != y for s, y in test), "of", len(test))
    assert auc > 0.9


def test_interaction(spark, docs_of):
    # the pair of terms is toxic, each alone is not: no additive weight can tell
    kinds = [("red blue", 1), ("red pad", 0), ("blue pad", 0), ("pad other", 0)]
    rows = [(i, kinds[i % 4][0] + f" filler{i % 7}") for i in range(1200)]
    labels = spark.createDataFrame([(i, kinds[i % 4][1]) for i in range(1200)], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity(docs_of(rows), labels).collect()}
    assert all(got[i] == kinds[i % 4][1] for i in got)


def many_neutral(n=1600):
    """Pairs decide: each of the four terms is as frequent in one class as in the other; 20000 other words say nothing."""
    rng = np.random.default_rng(1)
    kinds = [("red blue", 1), ("green gold", 1), ("red gold", 0), ("green blue", 0)]
    return [(i, " ".join(f"{x:05x}" for x in rng.integers(0, 20000, 60)) + " " + kinds[i % 4][0], kinds[i % 4][1]) for i in range(n)]


def test_interaction_among_neutral_words(spark, docs_of):
    rows = many_neutral()
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = [r for r in toxicity(docs_of([r[:2] for r in rows]), labels).collect() if r.held_out]
    assert len(got) > 250 and sum(r.predicted == rows[r.doc_id][2] for r in got) > 0.95 * len(got)


def test_every_bucket_has_parameters():
    # an insult in five texts of 1605 and 20000 words that differ by chance
    rows = many_neutral() + [(0, "zounds", 1)] * 5
    doc, bucket = term_pairs([t.encode() for _, t, _ in rows])
    model = fit(doc, bucket, np.array([y for *_, y in rows]), 0.5)
    assert set(model["chosen"]) == set(bucket) and (model["v"] != 0).any(1).all()
    rare = term_pairs([b"zounds"])[1]
    assert (model["w"][np.isin(model["chosen"], rare)] > 0).all()


def test_edges(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (None, "x"), (3, "y " * 10000), (3, "y")])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity(docs, none).collect()
    assert len(got) == 5 and {round(r.score, 9) for r in got} == {0.25}
    odd = spark.createDataFrame([(1, None), (2, 1), (2, 0), (4, 0), (None, 1)], "doc_id long, toxic int")
    assert toxicity(docs, odd).count() == 5
    assert clean_rows(docs, none).columns == docs.columns
    assert toxicity(docs_of([]), odd).count() == 0


def test_fit_memory(monkeypatch):
    # 3 million terms: a handful of 64-bit arrays of them would be 120 MB and more
    monkeypatch.setattr(toxicity_module, "EPOCHS", 0)
    doc = np.repeat(np.arange(3000, dtype=np.int32), 1000)
    bucket = (np.arange(len(doc)) * 7919 % 50_000).astype(np.int32)
    tracemalloc.start()
    model = fit(doc, bucket, np.arange(3000) % 2, 0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (model["chosen"] == np.unique(bucket)).all() and peak < 60e6


def test_fit_takes_rows_in_any_order():
    rng = np.random.default_rng(2)
    doc, y = np.repeat(np.arange(40), 5), np.arange(40) % 2
    bucket = rng.permutation(200) % 30
    mixed = rng.permutation(200)
    by_doc = mixed[np.argsort(doc[mixed], kind="stable")]
    a, b = fit(doc[mixed], bucket[mixed], y, 0.5), fit(doc[by_doc], bucket[by_doc], y, 0.5)
    assert a["w0"] == b["w0"] and (a["w"] == b["w"]).all() and (a["v"] == b["v"]).all()

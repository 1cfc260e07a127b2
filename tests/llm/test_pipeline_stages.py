"""Each stage of corpus_pipeline against a plain version on its own input."""

import importlib
import re
from collections import defaultdict

import corpus_pipeline
from tidebar.llm.pieces import decode
from tidebar.llm.toxicity import scored, train

SF = "/root/testdata/sf0.01"
brute_windows = importlib.import_module("test_decontaminate").brute
brute_components = importlib.import_module("test_jaccard_join").brute


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        rows = {r.doc_id: r for r in out.collect()}
        assert len(rows) == out.count()
        texts = {i: r.text for i, r in before.items()}
        if name == "toxicity":
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            scores = {r.doc_id: r._score for r in scored(docs, train(docs, labels)).collect()}
            want = {i for i in before if scores[i] < 0.5}
            assert 0 < len(want) < len(before)
        elif name == "exact_dedup":
            last = {}
            for i, t in texts.items():
                last[t] = max(i, last.get(t, i))
            want = set(last.values())
        elif name == "ngram_jaccard_join":
            want = {i for i, _, c in brute_components(sorted(texts.items())) if i == c}
            assert len(want) < len(before)
        elif name == "benchmark_decontamination":
            # the plain search is slow: only texts that share three words in a row with an item go through it
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            three = lambda t: {tuple(w[k : k + 3]) for w in [re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.lower())] for k in range(len(w) - 2)}
            grams, own = defaultdict(set), {}
            for k, (_, t) in enumerate(items):
                for g in three(t):
                    grams[g].add(k)
            for i, t in texts.items():
                own[i] = sorted({k for g in three(t) for k in grams.get(g, ())})
            want = {i for i, t in texts.items() if not any(brute_windows([(i, t)], [items[k]])[0][4] for k in own[i])}
            assert len(want) < len(before)
        else:
            want = set(before)
            assert {r.doc_id: r.text for r in decode(out).collect()} == texts
        assert set(rows) == want, name
        if name != "sentencepiece":
            assert out.columns == columns and all(rows[i] == before[i] for i in rows)
        seen.append(len(rows))
        docs = out
    assert seen == sorted(seen, reverse=True)


def test_nulls_and_empty(spark, tmp_path):
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    kind = spark.read.parquet(f"{SF}/documents.parquet").schema
    docs = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", None, 0), (2, "", None, "s", None), (3, "a b", None, None, None), (3, "a b", None, None, None)], kind)
    for frame, n in ((docs, {"toxicity": 5, "exact_dedup": 2, "ngram_jaccard_join": 2, "benchmark_decontamination": 2, "sentencepiece": 2}), (docs.limit(0), {})):
        for name, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, str(tmp_path))
            assert frame.count() == n.get(name, 0), name

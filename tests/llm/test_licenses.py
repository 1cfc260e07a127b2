import math
import re
from collections import Counter

from pyspark.sql import functions as F

from tidebar.llm.licenses import LEAST, NOTICE, TEMPLATES, license_scan

SCHEMA = "doc_id long, text string, path string, dir string, line string"
ROWS = [
    (1, "Intro\nLicensed under the Apache License, Version 2.0.\nbody", "a/b/c/one"),
    (2, "nothing here", "a/b/c/two"),
    (3, None, "a/b/three"),
    (4, "Released under the MIT License.\nAlso: licensed under CC BY-NC 4.0.", "a/four"),
    (5, "", "a/b/x/y/five"),
    (6, "my driving licence is blue and has nothing to do with it", "z/six"),
    (7, "released UNDER the mit license!!", "z/w/seven"),
    (8, "plain", "z/w/q/eight"),
    (9, "plain", None),
    (10, "plain", "top"),
    (None, "plain", "a/b/c/two"),
    (2, "nothing here", "a/b/c/two"),
    (11, "word " * 30000 + "\nThis work is licensed under the GNU General Public License, version 3.", "a/b/c/last"),
    (12, "Released under the MIT License.", "a/b/c/later"),
]


def brute(rows):
    terms = lambda t: re.findall("[a-z0-9]+", t.lower())
    found = [(i, r[0], line) for i, r in enumerate(rows) for line in (r[1] or "").split("\n") if re.search(NOTICE, line)]
    corpus = [line for *_, line in found] + list(TEMPLATES.values())
    df = Counter(t for line in corpus for t in set(terms(line)))
    vector = lambda text: {t: n * (math.log((len(corpus) + 1) / (df[t] + 1)) + 1) for t, n in Counter(terms(text)).items()}

    def cosine(a, b):
        dot = sum(w * b.get(t, 0) for t, w in a.items())
        return dot / math.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values())) if dot else 0.0

    own = {}
    for i, _, line in found:
        score, name = min((-round(cosine(vector(line), vector(t)), 6), n) for n, t in TEMPLATES.items())
        if -score >= LEAST:
            own.setdefault(i, set()).add((score, name, line))
    folder = lambda p: None if p is None else p.rpartition("/")[0]
    files = {}
    for i, r in enumerate(rows):
        if i in own and folder(r[2]) is not None:
            key = (math.inf if r[0] is None else r[0], min(own[i])[1])
            files[folder(r[2])] = min(files.get(folder(r[2]), key), key)
    out = []
    for i, (d, _, p) in enumerate(rows):
        if i in own:
            score, name, _ = min(own[i])
            out.append((d, name, -score, "notice", None, len(own[i])))
            continue
        at = folder(p)
        while at and at not in files:
            at = folder(at)
        hit = at is not None and at in files
        out.append((d, files[at][1] if hit else None, None, "directory" if hit else "none", at if hit else None, 0))
    return sorted(out, key=repr)


def test_brute_force(spark):
    docs = spark.createDataFrame([(*r, "x", "y") for r in ROWS], SCHEMA)
    got = license_scan(docs, F.col("path"))
    assert sorted([tuple(r) for r in got.collect()], key=repr) == brute(ROWS)
    assert [x for x in brute(ROWS) if x[3] == "directory"]


def test_native_plan_and_empty(spark):
    docs = spark.createDataFrame([(*r, "x", "y") for r in ROWS], SCHEMA)
    plan = license_scan(docs, F.col("path"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    assert license_scan(docs.where("false"), F.col("path")).count() == 0


def test_oracle(same_as_oracle):
    assert {r[-1] for r in same_as_oracle("op5_license_scans")}

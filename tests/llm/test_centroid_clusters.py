import hashlib
import math
import random

import numpy as np
from hypothesis import given, settings, strategies as st

from tidebar.llm.centroid_clusters import centroid_clusters, loosening, narrow, scaled_vectors, widen

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, x string"
COLS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def plain(rows, k=16, rounds=3, width=64, scale=64):
    held = [(i, [math.floor(max(-(2**27), min(2**27, scale * x))) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(held, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [list(v) for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in held:
            groups.setdefault(near(v)[1], []).append(v)
        for j, vs in groups.items():
            centroids[j] = [sum(col) // len(vs) for col in zip(*vs)]
    found = [(i, *near(v)[::-1]) for i, v in held]
    own = {}
    for _, j, d in found:
        own[j] = own.get(j, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, own[j], sum(own.values()), sha[j]) for i, j, d in found), key=str)


def run(spark, rows):
    out = centroid_clusters(spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA))
    return sorted((tuple(r)[:6] for r in out.select(COLS).collect()), key=str)


def test_like_plain(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 0.3, (9, 64))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 9] + rng.normal(0, 0.08, 64)]) for i in range(400)]
    assert run(spark, rows) == plain(rows)


def test_ties_repeats_and_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(-1, 1))] * 64) for i in range(60)]  # three places: many equal distances
    rows += [(7, [0.25] * 64), (7, [0.25] * 64), (None, [0.5] * 64), (100, None), (101, [1.0] * 63), (102, [1.0] * 63 + [nan]), (103, [1.0] * 63 + [inf]), (104, [1.0] * 63 + [None]), (105, [])]
    assert run(spark, rows) == plain(rows)


def test_large_components(spark):
    rows = [(i, [float(np.float32(x)) for x in np.linspace(-1, 1, 64) * 10.0 ** (i % 12)]) for i in range(40)] + [(50, [3e38] * 64), (51, [-3e38] * 64)]
    assert run(spark, rows) == plain(rows)


def test_few_vectors_and_empty(spark):
    rows = [(3, [0.1] * 64), (4, [0.9] * 64)]
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == []
    assert run(spark, rows[:1]) == plain(rows[:1])


def test_third_of_rows_equal(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [0.5] * 64 if i % 3 == 0 else [float(np.float32(x)) for x in rng.normal(0, 0.2, 64)]) for i in range(300)]
    assert run(spark, rows) == plain(rows)


def test_most_vectors_are_settled_by_the_bound(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 1, (16, 64))
    rows = [(i, [float(x) for x in centres[i % 16] + rng.normal(0, 0.02, 64)]) for i in range(800)]
    out = centroid_clusters(spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA))
    assert np.mean([r["scans"] for r in out.select("scans").collect()]) < 3.5


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(2, 5), st.sampled_from([1, 2, 3, 8]))
def test_loosening_is_safe_and_never_above_the_drift(seed, k, width):
    rng = np.random.default_rng(seed)
    old = rng.integers(-50, 50, (k, width)).astype(float)
    new = old + rng.integers(-9, 9, (k, width)) * rng.integers(0, 2, (k, 1))
    x = rng.integers(-60, 60, (200, width)).astype(float)
    far = lambda p, c: np.sqrt(((p[:, None] - c[None]) ** 2).sum(2))
    before, after = far(x, old), far(x, new)
    own = before.argmin(1)
    radius = np.array([before[own == i, i].max(initial=0) for i in range(k)])
    less = loosening(old, new, radius)
    for i in range(k):
        for j in range(k):
            if i != j and (own == i).any():
                assert (before[own == i, j] - after[own == i, j] <= less[i] + 1e-6).all()
    drift = np.sqrt(((new - old) ** 2).sum(1))
    assert (less <= drift.max() + 1e-6).all()


def test_loosening_beats_the_drift():
    old = np.array([[0.0, 0.0], [100.0, 0.0]])
    new = np.array([[0.0, 0.0], [100.0, 10.0]])  # sideways: hardly any nearer
    assert loosening(old, new, np.array([5.0, 5.0]))[0] < 2
    new = np.array([[0.0, 0.0], [110.0, 0.0]])  # away
    assert loosening(old, new, np.array([5.0, 5.0]))[0] < 1e-6


def test_narrow_round_trip():
    x = np.array([[1, -128, 127], [-129, 0, 3], [1 << 27, -(1 << 27), 0], [0, 0, 0]], np.int64)
    assert (widen(narrow(x), 3) == x).all()


def test_scaled_vectors_reads_doubles(spark):
    df = spark.createDataFrame([(1, [0.1] * 64)], "vec_id long, embedding array<double>")
    assert scaled_vectors(df).first()["x"] == [6] * 64


def test_query(same_as_oracle):
    assert len(same_as_oracle("op12_centroid_clusters")) >= 200

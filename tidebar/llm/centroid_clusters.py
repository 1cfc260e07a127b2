"""Lloyd clustering of integer vectors with lower bounds that loosen by planar geometry.

Each vector keeps its centroid, its exact distance and one lower bound for the distance to every
other centroid.  When the centroids move, the bound need not shrink by the full drift.  Let the
vectors of a cluster lie in a sphere (old centroid c, radius r), and let another centroid move from a
to b, with m in the middle.  For a vector x

    d(x, a) - d(x, b) = 2 (b - a).(x - m) / (d(x, a) + d(x, b)) <= |b - a| cos(angle of x - m and b - a),

since d(x, a) + d(x, b) >= 2 |x - m|.  In the plane through a, b and c the sphere takes up the angle
asin(r / |c - m|) on either side of c - m, so the cosine is at most that of the angle of c - m and b - a
less this one (1 if m lies in the sphere, nothing if all of it lies behind m).  The bound of a cluster's
vectors loosens by the largest of these over the other centroids.  Vectors whose exact distance to
their own centroid is below the bound keep it; all others, ties included, are compared with every
centroid in exact integers.

State is written after each round to the shared folder; centroids and sums (k rows) go through the driver.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidebar.session import cut_lineage

WIDTH = 64  # components of a vector
CLUSTERS = 16
ROUNDS = 3
SCALE = 64
REACH = 1 << 27  # scaled components are held within this, so that squared distances fit a long
EXACT = 1 << 20  # components up to which doubles hold squared distances exactly
STATE = "vec_id long, v binary, cluster int, distance long, bound double, scans int"


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """By how much the bound of each cluster's vectors shrinks when centroids ``old`` move to ``new``."""
    k = len(old)
    out = np.zeros(k)
    move = new - old
    drift = np.sqrt((move**2).sum(1))
    middle = (old + new) / 2
    for i in range(k):
        for j in range(k):
            if i == j or drift[j] == 0:
                continue
            to = old[i] - middle[j]
            away = math.sqrt(float((to**2).sum()))
            if away <= radius[i]:
                most = 1.0
            else:
                angle = math.acos(max(-1.0, min(1.0, float(to @ move[j]) / (away * drift[j]))))
                most = math.cos(max(0.0, angle - math.asin(radius[i] / away)))
            out[i] = max(out[i], drift[j] * min(1.0, max(0.0, most + 1e-9)))
    return out


def squares(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors to all centroids."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        return ((a**2).sum(1)[:, None] - 2 * (a @ c.T) + (c**2).sum(1)[None, :]).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)


def narrow(x: np.ndarray) -> list[bytes]:
    """Each vector in the fewest bytes a component that hold it."""
    top = np.abs(x).max(1, initial=0)
    kinds = np.where(top < 128, 1, np.where(top < 32768, 2, 4))
    out = [b""] * len(x)
    for size, kind in ((1, np.int8), (2, np.int16), (4, np.int32)):
        at = np.flatnonzero(kinds == size)
        for i, row in zip(at.tolist(), x[at].astype(kind)):
            out[i] = row.tobytes()
    return out


def widen(blobs: list[bytes], width: int) -> np.ndarray:
    sizes = np.array([len(b) // width for b in blobs])
    out = np.zeros((len(blobs), width), np.int64)
    for size, kind in ((1, np.int8), (2, np.int16), (4, np.int32)):
        at = np.flatnonzero(sizes == size)
        if len(at):
            out[at] = np.frombuffer(b"".join(blobs[i] for i in at), kind).reshape(len(at), width)
    return out


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster (the smaller number on ties), squared distance, and the distance to the second nearest."""
    d = squares(x, centroids)
    best = d.argmin(1)
    least = d[np.arange(len(x)), best]
    if len(centroids) == 1:
        return best, least, np.full(len(x), np.inf)
    d[np.arange(len(x)), best] = np.iinfo(np.int64).max
    return best, least, np.sqrt(d.min(1).astype(np.float64))


def _rows(ids, blobs, cluster, distance, bound, scans):
    arrays = [ids, pa.array(blobs, pa.binary()), pa.array(cluster.astype(np.int32)), pa.array(distance.astype(np.int64)), pa.array(bound.astype(np.float64)), pa.array(scans.astype(np.int32))]
    return pa.RecordBatch.from_arrays(arrays, ["vec_id", "v", "cluster", "distance", "bound", "scans"])


def first_assignment(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    width = centroids.shape[1]

    def assign(batches):
        for rows in batches:
            if rows.num_rows:
                x = np.asarray(rows.column("x").flatten()).reshape(-1, width)
                cluster, distance, bound = nearest(x, centroids)
                yield _rows(rows.column("vec_id"), narrow(x), cluster, distance, bound, np.ones(len(x)))

    return cut_lineage(vectors.mapInArrow(assign, STATE))


def next_assignment(state: DataFrame, old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> DataFrame:
    width, less = new.shape[1], loosening(old.astype(np.float64), new.astype(np.float64), radius)

    def assign(batches):
        for rows in batches:
            if not rows.num_rows:
                continue
            blobs = rows.column("v").to_pylist()
            x = widen(blobs, width)
            cluster = rows.column("cluster").to_numpy().astype(np.int64)
            bound = rows.column("bound").to_numpy() - less[cluster]
            scans = rows.column("scans").to_numpy().astype(np.int64)
            distance = ((x - new[cluster]) ** 2).sum(1)
            unsure = np.flatnonzero(~(np.sqrt(distance.astype(np.float64)) * (1 + 1e-9) + 1e-9 < bound))
            if len(unsure):
                cluster[unsure], distance[unsure], fresh = nearest(x[unsure], new)
                bound = bound.copy()
                bound[unsure] = fresh
                scans[unsure] += 1
            yield _rows(rows.column("vec_id"), blobs, cluster, distance, bound, scans)

    return cut_lineage(state.mapInArrow(assign, STATE))


def moved(state: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centroids at the floor of the mean of their vectors (empty ones stay) and the radius of each cluster."""
    width = centroids.shape[1]

    def partial(batches):
        """Sums per batch and cluster."""
        for rows in batches:
            if rows.num_rows:
                x, cluster = widen(rows.column("v").to_pylist(), width), rows.column("cluster").to_numpy()
                distance = rows.column("distance").to_numpy()
                here = np.unique(cluster)
                out = [(int(c), int((cluster == c).sum()), int(distance[cluster == c].max()), x[cluster == c].sum(0).tolist()) for c in here]
                yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())))], ["cluster", "n", "far", "total"])

    sums = state.select("v", "cluster", "distance").mapInArrow(partial, "cluster int, n long, far long, total array<long>").groupBy("cluster")
    sums = sums.agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.array(*[F.sum(F.col("total")[i].cast("decimal(38,0)")) for i in range(width)]).alias("total"))
    new, radius = centroids.copy(), np.zeros(len(centroids))
    for r in sums.collect():  # one row per centroid
        new[r["cluster"]] = [int(t) // r["n"] for t in r["total"]]
        radius[r["cluster"]] = math.sqrt(r["far"]) * (1 + 1e-9)
    return new, radius


def scaled_vectors(rows: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """vec_id, x (floor of scale times each component) of the vectors with ``width`` finite components."""
    v = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    fine = (F.size("x") == width) & F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    hold = lambda e: F.floor(F.greatest(F.least(e * F.lit(float(scale)), F.lit(float(REACH))), F.lit(float(-REACH))))
    return v.where(F.col("x").isNotNull() & F.coalesce(fine, F.lit(False))).select("vec_id", F.transform("x", hold).cast("array<long>").alias("x"))


def centroid_clusters(rows: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, scans: one row per vector kept.

    Vectors with another number of components, or with a null or non-finite one, are left out; the
    others become floor(scale * component), held within +-2^27.  The first centroids are the ``k`` vectors
    with the smallest SHA-256 of ``1:<vec_id>`` (fewer if there are fewer vectors; equal hashes in the
    order of their components; vectors without an id come last and have a null vec_id in the result).
    Repeated rows are vectors of their own.  Ties go to the smaller centroid; an empty centroid stays
    where it is.  ``scans`` counts the assignments in which the vector was compared with all centroids.
    An inertia beyond a long is null.  An empty table gives no rows; other columns are ignored.
    """
    vectors = scaled_vectors(rows, width, scale)
    seeds = vectors.select(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    centroids = np.array([r["x"] for r in seeds] or [[0] * width], np.int64)
    state = first_assignment(vectors, centroids)
    for _ in range(rounds):
        new, radius = moved(state, centroids)
        state, centroids = next_assignment(state, centroids, new, radius), new
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    sums = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # one row per centroid
    total = sum(int(r["s"]) for r in sums)
    fits = lambda n: n if n < 1 << 63 else None
    table = [(r["cluster"], fits(int(r["s"])), fits(total), digest[r["cluster"]]) for r in sums]
    about = rows.sparkSession.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scans")

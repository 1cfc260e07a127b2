"""Near copies by circulant MinHash, banding and exact Jaccard verification.

1. *Signatures.*  Two permutations make all coordinates: the first puts every shingle on a place of a
   circle of 2^32 places, the second ranks the places, and coordinate i is the smallest rank among the
   set's places after a turn of the circle by i.  ``BANDS`` bands of ``ROWS`` coordinates name the buckets;
   the low byte of each coordinate is kept for estimates.
2. *Buckets.*  Equal sets are one set from here on.  Each set first meets only the hub of its buckets (the
   member with the smallest hash); pairs whose estimate is far too low go, the others are verified on
   their full shingle sets, and links give components.
3. *What is left.*  Pairs inside a component cannot change it.  In a bucket that still holds several
   components, sets outside its main component meet a few hubs of that component; then buckets of at most
   ``LONG`` members are paired off, and in longer ones the sets outside the main component meet all
   members, in tiles of bounded size that verify in memory and return links only.  A pair is worked on in
   the first bucket that it shares.

A pair at the wanted similarity shares no bucket with probability (1 - 0.85^4)^24 < 3e-8, and is dropped by
the estimate with less than 1e-10.  Shingles are compared as 64-bit fingerprints (two that collide count
as one), and sets as 64-bit sums of these.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidebar.llm.components import components
from tidebar.llm.jaccard_join import shingle_sets
from tidebar.llm.textbatch import mix, slices, texts_of
from tidebar.operators.heavy import spread_join
from tidebar.session import cut_lineage

SHINGLE = 3  # words
SHARE = 85  # hundredths of the union that the intersection must reach
BANDS, ROWS = 24, 4
LONG = 16  # members of a bucket that are still paired off
HUBS, TURNS = 4, 2  # hubs that a set outside the main components of its buckets meets per turn
HEAVY = 20_000  # rows of one bucket or set that a task takes as they come
SIDE, TILE = 256, 1024  # sets of a tile: outside the main component, of all
HOLD = 1_000_000  # shingles of either side of a tile
PART = 1 << 16  # shingles whose places are turned at once
FEW = 2_000_000  # ids of asked documents that are broadcast at most
DOUBT = 1e-10


def ranks(places: np.ndarray) -> np.ndarray:
    """The second permutation: a bijection of 32-bit values."""
    x = places ^ (places >> np.uint32(16))
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """One row of ``size`` coordinates per set (all ones for an empty set)."""
    out = np.full((len(sets), size), 0xFFFFFFFF, np.uint32)
    n = np.array([len(s) for s in sets], np.int64)
    upto, a = np.cumsum(n), 0
    while a < len(sets):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PART, "right")))
        full = a + np.flatnonzero(n[a:b])
        if len(full):
            places = (mix(np.concatenate([sets[i] for i in full])) >> np.uint64(32)).astype(np.uint32)
            edge = np.cumsum(n[full]) - n[full]
            for i in range(size):
                out[full, i] = np.minimum.reduceat(ranks(places + np.uint32(i)), edge)
        a = b
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit bucket key per set and band."""
    part = sig.reshape(len(sig), bands, rows).astype(np.uint64)
    key = np.arange(bands, dtype=np.uint64)[None, :] + np.zeros((len(sig), 1), np.uint64)
    for i in range(rows):
        key = mix(key ^ (part[:, :, i] * np.uint64(0x9E3779B97F4A7C15)))
    return key.view(np.int64)


def least_agreement(size: int, share: int) -> int:
    """Coordinates that must agree: fewer have a probability below DOUBT at the wanted similarity (Chernoff)."""
    p = share / 100
    for need in range(int(size * p), 0, -1):
        q = need / size
        far = q * math.log(q / p) + (1 - q) * math.log((1 - q) / (1 - p)) if p < 1 and q < 1 else 0.0
        if q < p and size * far > -math.log(DOUBT):
            return need
    return 0


def set_ids(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([int(mix(mix(s).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s)))[0]) for s in sets], np.uint64).view(np.int64)


def sketches(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n, set_id, keys (one per band), sig (low bytes of the coordinates); null keys for an empty set."""

    def sketch(batches):
        for batch, texts in slices(batches):
            sets = shingle_sets(texts, k)
            sig = signatures(sets, bands * rows)
            n = np.array([len(s) for s in sets], np.int64)
            keys, low = band_keys(sig, bands, rows), sig.astype(np.uint8)
            arrays = [batch.column("doc_id"), pa.array(n), pa.array(set_ids(sets)), pa.array([x.tolist() if m else None for x, m in zip(keys, n)], pa.list_(pa.int64())), pa.array([x.tobytes() if m else None for x, m in zip(low, n)], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "set_id", "keys", "sig"])

    return docs.mapInArrow(sketch, "doc_id long, n long, set_id long, keys array<long>, sig binary")


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def likely(pairs: DataFrame, sets: DataFrame, share: int, size: int) -> DataFrame:
    """The pairs whose sizes fit and whose estimates do not rule them out."""
    need = least_agreement(size, share)

    def screen(batches):
        for rows in batches:
            if rows.num_rows:
                x, y = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.uint8).reshape(-1, size) for c in ("sig_a", "sig_b"))
                keep = pa.array((x == y).sum(1) >= need)
                yield pa.RecordBatch.from_arrays([rows.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])

    sigs = sets.select("set_id", "n", "sig")
    side = lambda c: sigs.select(F.col("set_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}"))
    met = spread_join(spread_join(pairs, side("a"), "a", "inner"), side("b"), "b", "inner")
    return met.where(100 * F.least("n_a", "n_b") >= share * F.greatest("n_a", "n_b")).select("a", "b", "sig_a", "sig_b").mapInArrow(screen, "a long, b long")


def own_texts(asked: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """set_id, text of the asked sets (set_id, doc_id); of rows that share a doc_id the one whose set it is."""

    def check(batches):
        for rows, held in slices(batches):
            keep = pa.array(rows.column("set_id").to_numpy() == set_ids(shingle_sets(held, k)))
            yield rows.filter(keep)

    wanted = asked.select("set_id", F.col("doc_id").alias("_id"))
    if asked.count() <= FEW:
        wanted = F.broadcast(wanted)
    found = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id"))).select("set_id", "text")
    return found.mapInArrow(check, "set_id long, text string").dropDuplicates(["set_id"])


def similar(x: np.ndarray, y: np.ndarray, share: int) -> bool:
    both = np.sort(np.concatenate([x, y]))
    inside = int((both[1:] == both[:-1]).sum())
    return 100 * inside >= share * (len(both) - inside)


def verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, share: int, k: int, size: int) -> DataFrame:
    """The pairs (a, b) of set ids whose full shingle sets are similar."""

    def verify(batches):
        for rows, left in slices(batches, "text_a"):
            right = texts_of(rows.column("text_b"))
            each = list(dict.fromkeys(left + right))  # a hub stands in many pairs
            known = dict(zip(each, shingle_sets(each, k)))
            keep = pa.array([similar(known[x], known[y], share) for x, y in zip(left, right)], pa.bool_())
            yield pa.RecordBatch.from_arrays([rows.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])

    pairs = cut_lineage(likely(both_ways(pairs), sets, share, size))
    asked = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()
    picked = cut_lineage(own_texts(asked.join(sets.select("set_id", "doc_id"), "set_id"), texts, k))
    side = lambda c: picked.select(F.col("set_id").alias(c), F.col("text").alias(f"text_{c}"))
    met = spread_join(spread_join(pairs, side("a"), "a", "inner"), side("b"), "b", "inner", by=F.col("a"))
    return cut_lineage(met.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long"))


def split_buckets(listed: DataFrame, roots: DataFrame, heavy: DataFrame) -> DataFrame:
    """Rows (key, set_id, n, m, hub, root, main, rest, total) of buckets that hold several components."""
    rows = cut_lineage(listed.join(roots.select(F.col("node").alias("set_id"), "root"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id")))
    parts = rows.groupBy("key", "root").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    main = parts.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.sum("c").alias("_c"), F.max("c").alias("_most"), F.sum("s").alias("total"), F.count("*").alias("_parts"))
    main = main.where("_parts > 1").select("key", "main", (F.col("_c") - F.col("_most")).alias("rest"), "total")
    return cut_lineage(spread_join(rows, main, "key", "inner", heavy))


def tiles(left: DataFrame, sets: DataFrame, texts: DataFrame, share: int, k: int, size: int, side: int, tile: int) -> DataFrame:
    """Links (a, b) between sets outside a long bucket's main component and all its members."""
    need = least_agreement(size, share)

    def match(t: pa.Table) -> pa.Table:
        key = t.column("key")[0].as_py()
        held, ids, roots = texts_of(t.column("text").combine_chunks()), t.column("set_id").to_pylist(), t.column("root").to_pylist()
        known = shingle_sets(held, k)
        n = np.array([len(s) for s in known])
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, size)
        keys = np.array(t.column("keys").to_pylist(), np.int64)
        outer = np.array(t.column("outer").to_pylist())
        group = {r: r for r in roots}

        def find(r):
            while group[r] != r:
                group[r] = group[group[r]]
                r = group[r]
            return r

        links, others = [], np.flatnonzero(~outer)
        for x in np.flatnonzero(outer).tolist():
            fits = others[(100 * np.minimum(n[others], n[x]) >= share * np.maximum(n[others], n[x])) & ((sig[others] == sig[x]).sum(1) >= need)]
            if len(fits):
                fits = fits[keys[fits, (keys[fits] == keys[x]).argmax(1)] == key]
            for y in fits.tolist():
                a, b = find(roots[x]), find(roots[y])
                if a != b and similar(known[x], known[y], share):
                    group[a] = b
                    links.append((ids[x], ids[y]))
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    deal = lambda salt, n: F.pmod(F.xxhash64("set_id", F.lit(salt)), n)
    pieces = lambda count, room: F.greatest(F.ceil(F.col(count) / room), F.ceil(F.col("total") / HOLD))
    placed = left.select("key", "set_id", "root", "main", pieces("rest", side).alias("_o"), pieces("m", tile).alias("_i"))
    outer = placed.where("root <> main").select("key", "set_id", "root", F.lit(True).alias("outer"), deal(1, F.col("_o")).alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_i") - 1)).alias("y"))
    inner = placed.select("key", "set_id", "root", F.lit(False).alias("outer"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_o") - 1)).alias("x"), deal(2, F.col("_i")).alias("y"))
    asked = left.select("set_id").distinct()
    picked = own_texts(asked.join(sets.select("set_id", "doc_id"), "set_id"), texts, k).join(sets.select("set_id", "keys", "sig"), "set_id")
    rows = outer.unionByName(inner).join(cut_lineage(picked), "set_id")
    return cut_lineage(rows.groupBy("key", "x", "y").applyInArrow(match, "a long, b long"))


def circulant_components(docs: DataFrame, share: int = SHARE, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, long: int = LONG, heavy: int = HEAVY, side: int = SIDE, tile: int = TILE) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept (it is its own component_id).

    Words are runs of non-blank characters with A-Z lowered.  A document with fewer than ``k`` words is
    one shingle; one without words has none and is linked with nothing: its component_id is its own
    doc_id.  Rows that share a doc_id are separate documents of that id; a null doc_id takes part, and is a
    component_id only where a component has no other.  An empty table gives no rows; other columns are
    ignored.
    """
    size = bands * rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    members = cut_lineage(sketches(texts, k, bands, rows))
    sets = cut_lineage(members.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sig").alias("sig")))

    postings = sets.select("set_id", "n", F.explode("keys").alias("key"))
    buckets = cut_lineage(postings.groupBy("key").agg(F.count("*").alias("m"), F.min_by("set_id", F.xxhash64("set_id")).alias("hub")).where("m > 1"))
    hot = buckets.where(F.col("m") > heavy).select("key")
    listed = cut_lineage(spread_join(postings, buckets, "key", "inner", hot))
    links = verified(listed.select(F.col("set_id").alias("a"), F.col("hub").alias("b")), sets, texts, share, k, size)
    roots = components(links)

    more = listed.where("m > 2")
    chosen = lambda salt: F.min_by("set_id", F.xxhash64("set_id", F.lit(salt)))
    left = split_buckets(more, roots, hot)
    for turn in range(TURNS):
        crowd = left.where(F.col("m") > long)
        if crowd.isEmpty():
            break
        names = [f"h{i}" for i in range(HUBS)]
        hubs = crowd.where("root = main").groupBy("key").agg(*[chosen(HUBS * turn + i + 1).alias(h) for i, h in enumerate(names)])
        met = spread_join(crowd.where("root <> main").select("key", "set_id"), hubs, "key", "inner", hot)
        met = met.groupBy("set_id").agg(*[F.min_by(h, F.xxhash64(h, F.lit(HUBS * turn + i + 1))).alias(h) for i, h in enumerate(names)])
        out = met.select(F.col("set_id").alias("a"), F.explode(F.array(*names)).alias("b"))
        found = verified(out, sets, texts, share, k, size)
        if found.isEmpty():
            break
        links = links.unionByName(found)
        roots = components(links)
        left = split_buckets(more, roots, hot)

    few = left.where(F.col("m") <= long).select("key", "set_id", "root", "hub")
    one, two = few.where("set_id <> hub").withColumnRenamed("set_id", "a"), few.where("set_id <> hub").select("key", F.col("set_id").alias("b"), F.col("root").alias("other"))
    pairs = one.join(two, "key").where("a < b AND root <> other").select("a", "b")
    found = verified(pairs, sets, texts, share, k, size)
    found = found.unionByName(tiles(left.where(F.col("m") > long), sets, texts, share, k, size, side, tile))
    if not found.isEmpty():
        roots = components(links.unionByName(found))

    # smallest doc_id of each component, by way of the sets
    own = cut_lineage(sets.select("set_id", "doc_id").join(roots.select(F.col("node").alias("set_id"), "root"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id")))
    least = own.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    least = spread_join(own.select("set_id", "root"), least, "root", "inner", rows=heavy).select("set_id", "component_id")
    out = spread_join(members.select("doc_id", "n", F.when(F.col("n") > 0, F.col("set_id")).alias("set_id")), least, "set_id", "left", rows=heavy, by=F.col("doc_id"))
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))

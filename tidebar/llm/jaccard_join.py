"""Exact Jaccard join on word shingles by a grouped prefix join, and its components.

1. *Order.*  Shingles are counted over all documents.  Those in at least ``LEAST_DF`` documents are
   frequent; if there are more than ``FREQUENT``, only those above the first power of two that
   leaves no more are, so the table has a bounded size and is broadcast.  The global order puts rarer
   shingles first, by powers of two of their count, then by hash.
2. *Prefixes.*  Two sets with the wanted similarity share a shingle among the first
   ``n - ceil(t * n) + 1`` of each.  Documents with the same prefix and size form one group, and only
   groups are indexed, each under the shingles of its prefix.
3. *Group pairs.*  Groups in one list of the index that have sizes within the bound become pairs; a
   pair stays if the shared prefix shingles and the rest of the sets can still reach the overlap.
   Lists of more than ``LONG`` groups are never paired off (with the order above they arise only where
   nearly all shingles of a set are frequent, in large families of near copies): their groups meet a
   few hubs, and afterwards only sets that are not yet in the list's main component meet the others, in
   tiles of bounded size that hold a parity bitmap of each set instead of its text: bits that differ
   bound the difference of two sets from below, so no similar pair is lost and few others leave a tile.
4. *Members.*  Pairs are expanded to distinct sets and verified on the texts, first along hubs, then
   every candidate pair whose ends lie in different components.  Pairs inside a component cannot
   change it, so no link between components is lost and families are not paired off.

Sets are compared as 64-bit shingle fingerprints.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tidebar.llm.components import components
from tidebar.llm.textbatch import ASCII_LOWER, Words, mix, ngram_hashes, slices
from tidebar.operators.heavy import spread_join
from tidebar.session import cut_lineage

SHINGLE = 5  # words
SHARE = 75  # hundredths of the union that the intersection must reach
FREQUENT = 4_000_000  # bound on the table of frequent shingles (five bytes each)
LEAST_DF = 16
LONG = 16  # groups in a list of the index that are still paired off
HUBS = 4  # hubs that each group outside a list's main component meets per round
ROUNDS = 2
SIDE, TILE = 512, 2048  # sets of a tile: outside the list's main component, of all
BITMAP = 2048  # bits of a set's parity bitmap
FIRST = 32  # lists of a set that tell whether a pair was met in an earlier list
FEW = 2_000_000  # rows of two ids that are broadcast at most
BUCKET = 12_000_000  # bytes of text whose shingles one bucket holds
FLUSH = 2_000_000  # shingles gathered before they are dealt to buckets
SIZE = (1 << 24) - 1  # largest set size that a group id holds; larger ones share it


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle fingerprints of each text; shorter texts are one shingle."""
    words = Words(texts, ASCII_LOWER)
    h = words.hashes
    grams = ngram_hashes(h, k) if words.n else h
    out = []
    for first, count in zip(words.first.tolist(), words.counts.tolist()):
        if count >= k:
            out.append(np.unique(grams[first : first + count - k + 1]))
        else:
            out.append(mix(ngram_hashes(h[first : first + count], count)[:1] ^ np.uint64(count)) if count else np.zeros(0, np.uint64))
    return out


def prefix_length(n, share: int = SHARE):
    return n - (share * n + 99) // 100 + 1


def pack(a: np.ndarray) -> bytes:
    """A sorted array as compressed differences, split into byte planes."""
    d = np.diff(a, prepend=a.dtype.type(0))
    return zstandard.compress(np.ascontiguousarray(d.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes(), 1)


def unpack(blob: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(size, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view(kind).ravel(), dtype=kind)


def spread(keys: np.ndarray, bits: int):
    """(bucket, from, to) of the runs of sorted 64-bit keys that share their first bits."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(keys)]):
        yield int(bucket[a]), a, b


def frequent_shingles(docs: DataFrame, bits: int, least_df: int, most: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (the first 32 + bits bits) of frequent shingles, sorted, and the level of each; at most ``most``."""

    def count(batches):
        held, size = [], 0

        def flush():
            keys, n = np.unique(np.concatenate(held) >> np.uint64(32 - bits), return_counts=True)
            rows = [(b, pack((keys[i:j] & np.uint64(0xFFFFFFFF)).astype(np.uint32)), zstandard.compress(np.minimum(n[i:j], 65535).astype(np.uint16).tobytes(), 1)) for b, i, j in spread(keys << np.uint64(32 - bits), bits)]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["bucket", "keys", "n"])

        for _, texts in slices(batches):
            sets = shingle_sets(texts, k)
            held += [s for s in sets if len(s)]
            size += sum(map(len, sets))
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def common(table: pa.Table) -> pa.Table:
        keys = np.concatenate([unpack(x, np.uint32) for x in table.column("keys").to_pylist()])
        n = np.concatenate([np.frombuffer(zstandard.decompress(x), np.uint16) for x in table.column("n").to_pylist()]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.diff(keys.astype(np.int64), prepend=-1))
        total = np.add.reduceat(n, first)
        often = total >= least_df
        level = np.floor(np.log2(total[often])).astype(np.uint8)
        sizes = np.bincount(level, minlength=64)
        return pa.table({"bucket": table.column("bucket")[:1], "keys": pa.array([keys[first][often].tobytes()], pa.binary()), "levels": pa.array([level.tobytes()], pa.binary()), "sizes": pa.array([sizes.tolist()], pa.list_(pa.int64()))})

    kinds = "bucket int, keys binary, levels binary, sizes array<long>"
    counted = cut_lineage(docs.mapInArrow(count, "bucket int, keys binary, n binary").groupBy("bucket").applyInArrow(common, kinds).where("length(keys) > 0"))
    sizes = {r.pos: r.n for r in counted.select(F.posexplode("sizes").alias("pos", "n")).groupBy("pos").agg(F.sum("n").alias("n")).collect()}
    least = 0
    while sum(n for level, n in sizes.items() if level >= least) > most:
        least += 1

    def above(batches):
        for rows in batches:
            keys, levels = [], []
            for x, y in zip(rows.column("keys").to_pylist(), rows.column("levels").to_pylist()):
                level = np.frombuffer(y, np.uint8)
                keys.append(np.frombuffer(x, np.uint32)[level >= least].tobytes())
                levels.append(level[level >= least].tobytes())
            yield pa.RecordBatch.from_arrays([rows.column("bucket"), pa.array(keys, pa.binary()), pa.array(levels, pa.binary())], ["bucket", "keys", "levels"])

    found = counted.select("bucket", "keys", "levels").mapInArrow(above, "bucket int, keys binary, levels binary").collect()
    found.sort(key=lambda r: r.bucket)
    keys = [np.frombuffer(r["keys"], np.uint32).astype(np.uint64) + np.uint64(r.bucket << 32) for r in found]
    none = [np.zeros(0, np.uint64)]
    return np.concatenate(keys or none), np.concatenate([np.frombuffer(r.levels, np.uint8) for r in found] or [np.zeros(0, np.uint8)])


class Order:
    """Rank of a shingle in the global order: level first, then hash."""

    def __init__(self, keys: np.ndarray, levels: np.ndarray, bits: int):
        self.keys, self.levels, self.shift = keys, levels, np.uint64(32 - bits)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self._slot(keys)] = True

    def _slot(self, keys):
        return (mix(keys) >> np.uint64(42)).astype(np.int64)

    def ranks(self, tokens: np.ndarray) -> np.ndarray:
        level = np.zeros(len(tokens), np.uint64)
        keys = tokens >> self.shift
        here = np.flatnonzero(self.maybe[self._slot(keys)])
        if len(here) and len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys[here]), len(self.keys) - 1)
            known = self.keys[at] == keys[here]
            level[here[known]] = self.levels[at[known]]
        return (level << np.uint64(58)) | (tokens >> np.uint64(6))


def index(docs: DataFrame, order, bits: int, share: int, k: int, buckets: int, most: int) -> DataFrame:
    """kind 0: documents (doc_id, group, set, n); kind 1: group pairs (a, b, shared); kind 2: long lists (rank, group)."""

    def postings(batches):
        ranks, groups, size, no = [], [], 0, 0

        def flush():
            r, g = np.concatenate(ranks), np.concatenate(groups)
            # buckets follow the hash part of the rank, so frequent shingles are dealt like others
            key = mix(r)
            at = np.lexsort((g, key))
            key, r, g = key[at], r[at], g[at]
            new = np.ones(len(r), bool)
            new[1:] = (r[1:] != r[:-1]) | (g[1:] != g[:-1])  # copies of one set within this batch
            key, r, g = key[new], r[new], g[new]
            rows = [(b, zstandard.compress(r[i:j].tobytes(), 1), zstandard.compress(np.ascontiguousarray(g[i:j]).tobytes(), 1)) for b, i, j in spread(key, bits)]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["bucket", "x", "y"])

        for rows, texts in slices(batches):
            sets = shingle_sets(texts, k)
            n = np.array([len(s) for s in sets], np.int64)
            edge = np.concatenate([[0], np.cumsum(n)])
            tokens = np.concatenate(sets)
            rank = order.value.ranks(tokens)
            take = prefix_length(n, share) * (n > 0)
            prefixes = [np.sort(rank[a:b])[:p] for a, b, p in zip(edge[:-1], edge[1:], take)]
            full = n > 0
            whole, head = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            if full.any():
                flat = np.concatenate(prefixes)
                pedge = np.concatenate([[0], np.cumsum(take)])[:-1][full]
                whole[full] = mix(np.add.reduceat(mix(tokens), edge[:-1][full]) + n[full].astype(np.uint64))
                head[full] = mix(np.add.reduceat(mix(flat), pedge))
                head[full] = (head[full] << np.uint64(24)) | np.minimum(n[full], SIZE).astype(np.uint64)
                ranks.append(flat)
                groups.append(np.repeat(head, take))
                size += len(flat)
            ids = rows.column("doc_id")
            blob = pa.RecordBatch.from_arrays([ids, pa.array(head.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(n)], ["doc_id", "g", "s", "n"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, blob.schema) as w:
                w.write_batch(blob)
            yield pa.RecordBatch.from_arrays([pa.array([buckets + no % buckets], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([None], pa.binary())], ["bucket", "x", "y"])
            no += 1
            if size >= FLUSH:
                yield flush()
                ranks, groups, size = [], [], 0
        if ranks:
            yield flush()

    def joined(table: pa.Table) -> pa.Table:
        xs = table.column("x").to_pylist()
        if table.column("bucket")[0].as_py() >= buckets:
            t = pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in xs])
            return pa.table([pa.array(np.zeros(t.num_rows, np.int32)), *(t.column(c).combine_chunks() for c in ("doc_id", "g", "s", "n"))], names=["kind", "x", "y", "z", "w"])
        rank = np.concatenate([np.frombuffer(zstandard.decompress(x), np.uint64) for x in xs])
        group = np.concatenate([np.frombuffer(zstandard.decompress(x), np.uint64) for x in table.column("y").to_pylist()])
        n = (group & np.uint64(SIZE)).astype(np.int64)
        at = np.lexsort((group, n, rank))
        rank, group, n = rank[at], group[at], n[at]
        new = np.ones(len(rank), bool)
        new[1:] = (rank[1:] != rank[:-1]) | (group[1:] != group[:-1])
        rank, group, n = rank[new], group[new], n[new]
        same = rank[1:] == rank[:-1]
        some = np.zeros(len(rank), bool)
        some[1:] |= same
        some[:-1] |= same
        rank, group, n = rank[some], group[some], n[some]
        first = np.flatnonzero(np.append(True, rank[1:] != rank[:-1])) if len(rank) else np.zeros(0, np.int64)
        length = np.diff(np.append(first, len(rank)))
        hot = np.repeat(length > most, length)
        lists = (rank[hot].view(np.int64), group[hot].view(np.int64))
        rank, group, n = rank[~hot], group[~hot], n[~hot]
        left, right = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        low, step = np.arange(len(rank)), 1
        while True:  # partners at distance 1, 2, ... in lists sorted by size
            low = low[low + step < len(rank)]
            low = low[(rank[low] == rank[low + step]) & ((100 * n[low] >= share * n[low + step]) | (n[low + step] == SIZE))]
            if not len(low):
                break
            left.append(np.minimum(group[low], group[low + step]))
            right.append(np.maximum(group[low], group[low + step]))
            step += 1
        a, b = np.concatenate(left), np.concatenate(right)
        at = np.lexsort((b, a))
        a, b = a[at], b[at]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        first = np.flatnonzero(new)
        shared = np.diff(np.append(first, len(a)))
        kind = np.concatenate([np.ones(len(first), np.int32), np.full(len(lists[0]), 2, np.int32)])
        zero = np.zeros(len(lists[0]), np.int64)
        return pa.table({"kind": kind, "x": np.concatenate([a[first].view(np.int64), lists[0]]), "y": np.concatenate([b[first].view(np.int64), lists[1]]), "z": np.concatenate([shared, zero]), "w": np.concatenate([shared * 0, zero])})

    return docs.mapInArrow(postings, "bucket int, x binary, y binary").groupBy("bucket").applyInArrow(joined, "kind int, x long, y long, z long, w long")


def bitmap(shingles: np.ndarray, size: int = BITMAP) -> bytes:
    """Parity of the number of shingles per slot: bits that differ between two sets are at most the shingles that do."""
    odd = np.bincount((mix(shingles) % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _small(ids: DataFrame) -> DataFrame:
    """Marked for a broadcast if it has at most ``FEW`` rows (counted)."""
    return F.broadcast(ids) if ids.count() <= FEW else ids


def similar(pairs: DataFrame, texts: DataFrame, share: int, k: int) -> DataFrame:
    """The pairs (a, b) of set ids whose sets are similar; ``texts`` has one text per set (set_id, text)."""

    def verify(batches):
        for rows, left in slices(batches, "text_a"):
            right = [t or b"" for t in rows.column("text_b").cast(pa.binary()).to_pylist()]
            each = list(dict.fromkeys(left + right))  # a hub stands in many pairs
            sets = dict(zip(each, shingle_sets(each, k)))
            ok = []
            for x, y in zip(map(sets.get, left), map(sets.get, right)):
                both = np.sort(np.concatenate([x, y]))
                inside = int((both[1:] == both[:-1]).sum())
                ok.append(100 * inside >= share * (len(both) - inside))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([rows.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])

    pairs = cut_lineage(pairs)
    asked = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()
    texts = texts.join(_small(asked), "set_id", "left_semi")  # only these are shuffled
    one = texts.select(F.col("set_id").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("set_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long")


def jaccard_components(docs: DataFrame, share: int = SHARE, k: int = SHINGLE, frequent: int = FREQUENT, least_df: int = LEAST_DF, bucket: int = BUCKET, most: int = LONG, side: int = SIDE, tile: int = TILE) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), one row per row of ``docs``.

    Words are runs of non-blank characters with A-Z lowered.  A document with fewer than ``k`` words
    is one shingle; one without words has none and is linked with nothing: its component_id is its
    own doc_id.  Equal sets are linked whatever their text.  Rows that share a doc_id are separate
    documents of that id; a null doc_id takes part, and is a component_id only where a component has
    no other.  An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, (max(1, total // bucket) - 1).bit_length())
    order = spark.sparkContext.broadcast(Order(*frequent_shingles(texts, bits, least_df, frequent, k), bits))
    found = cut_lineage(index(texts, order, bits, share, k, 1 << bits, most))

    members = found.where("kind = 0").select(F.col("x").alias("doc_id"), F.col("y").alias("g"), F.col("z").alias("set_id"), F.col("w").alias("n"))
    sets = members.where("n > 0").groupBy("set_id", "g").agg(F.min("doc_id").alias("doc_id"))
    by_group = sets.groupBy("g").agg(F.min("set_id").alias("rep"), F.count("*").alias("sets"))
    many = by_group.where("sets > 1")
    lists = found.where("kind = 2").select(F.col("x").alias("rank"), F.col("y").alias("g"))

    size = lambda c: F.col(c).bitwiseAND(SIZE)
    rest = lambda c: F.floor((share * size(c) + 99) / 100) - 1  # noqa: E731  elements outside the prefix
    need = F.ceil(share * (size("a") + size("b")) / (100 + share))
    in_long = lists.groupBy("g").agg(F.count("*").alias("q"))
    pairs = found.where("kind = 1").groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("z").alias("c"))
    for c in ("a", "b"):
        pairs = pairs.join(in_long.select(F.col("g").alias(c), F.col("q").alias(f"q{c}")), c, "left")
    seen = F.col("c") + F.least(F.coalesce("qa", F.lit(0)), F.coalesce("qb", F.lit(0)))  # shared in the prefixes, at most
    pairs = cut_lineage(pairs.where((seen + F.greatest(rest("a"), rest("b")) >= need) | (F.greatest(size("a"), size("b")) == SIZE)).select("a", "b"))
    fits = lambda a, b: (100 * F.least(size(a), size(b)) >= share * F.greatest(size(a), size(b))) | (F.greatest(size(a), size(b)) == SIZE)

    # first: every group with two partners that its neighbours are likely to choose too, and every group inside itself
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    chosen = lambda c, salt: F.min_by(c, F.xxhash64(c, F.lit(salt)))
    salts = (0, 1)
    heads = lists.groupBy("rank").agg(*[chosen("g", i).alias(f"h{i}") for i in salts])
    near = lists.join(heads, "rank").groupBy("g").agg(*[chosen(f"h{i}", i).alias(f"h{i}") for i in salts])
    near = near.unionByName(both.groupBy(F.col("a").alias("g")).agg(*[chosen("b", i).alias(f"h{i}") for i in salts]))
    near = near.select(F.col("g").alias("a"), F.explode(F.array(*[f"h{i}" for i in salts])).alias("b")).where(F.col("a") != F.col("b")).where(fits("a", "b"))
    near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ga, gb = (by_group.select(F.col("g").alias(x), F.col("rep").alias(f"rep_{x}")) for x in ("a", "b"))
    starts = near.join(ga, "a").join(gb, "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    inside = sets.join(many, "g").select(F.col("rep").alias("a"), F.col("set_id").alias("b"))

    # texts of all sets that can take part in any round
    asked = both.select(F.col("a").alias("g")).unionByName(lists.select("g")).unionByName(many.select("g")).distinct()
    asked = cut_lineage(sets.join(asked, "g", "left_semi"))
    plain = texts.withColumnRenamed("doc_id", "id")
    picked = cut_lineage(_own_texts(plain.join(_small(asked), F.col("doc_id").eqNullSafe(F.col("id"))).select("set_id", "text"), k))
    links = cut_lineage(similar(starts.unionByName(inside).where("a <> b").distinct(), picked, share, k))
    roots = components(links)

    groups = asked.select("set_id", "g")
    listed = lists.select(F.col("rank").alias("key"), "g")
    listed = cut_lineage(listed.unionByName(many.select(F.col("g").alias("key"), "g")).join(groups, "g"))
    for turn in range(ROUNDS):
        # sets outside the main component of a list meet some of it
        hot = _split(listed, roots)
        hubs = hot.where("root = main").groupBy("key").agg(*[chosen("set_id", 10 * turn + i + 2).alias(f"h{i}") for i in range(HUBS)])
        out = hot.where("root <> main").join(hubs, "key").groupBy("set_id").agg(*[chosen(f"h{i}", 10 * turn + i + 2).alias(f"h{i}") for i in range(HUBS)])
        more = out.select("set_id", F.explode(F.array(*[f"h{i}" for i in range(HUBS)])).alias("h"))
        more = cut_lineage(similar(more.select(F.least("set_id", "h").alias("a"), F.greatest("set_id", "h").alias("b")).distinct(), picked, share, k))
        if more.isEmpty():
            break
        links = links.unionByName(more)
        roots = components(links)

    # last: every candidate pair whose ends are not in one component yet
    placed = cut_lineage(groups.join(roots, F.col("set_id") == F.col("node"), "left").select("g", "set_id", F.coalesce("root", "set_id").alias("root")))
    pa_, pb_ = (placed.select(F.col("g").alias(x), F.col("set_id").alias(f"s{x}"), F.col("root").alias(f"r{x}")) for x in ("a", "b"))
    cross = pairs.join(pa_, "a").join(pb_, "b").where("ra <> rb")
    # pairs that share long lists; many of them are in ``pairs`` too
    met = tiles(_split(listed, roots), picked, share, side, tile)
    cross = cross.select(F.least("sa", "sb").alias("a"), F.greatest("sa", "sb").alias("b")).unionByName(met).distinct()
    more = cut_lineage(similar(cross, picked, share, k))
    if not more.isEmpty():
        roots = components(links.unionByName(more))

    # smallest doc_id of each component, by way of the sets
    own = sets.join(roots, F.col("set_id") == F.col("node"), "left").select("set_id", F.coalesce("root", "set_id").alias("root"), "doc_id")
    own = cut_lineage(own)
    least = own.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    least = own.join(least, "root").groupBy("set_id").agg(F.min("component_id").alias("component_id"))
    out = members.join(least, "set_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _own_texts(picked: DataFrame, k: int) -> DataFrame:
    """One text per set id, the one whose set it is (rows that share a doc_id bring others along), its size and bitmap."""

    def check(batches):
        for rows, texts in slices(batches):
            sets = shingle_sets(texts, k)
            ids = np.array([int(mix(mix(s).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s)))[0]) for s in sets], np.uint64).view(np.int64)
            rows = pa.RecordBatch.from_arrays([rows.column("set_id"), rows.column("text"), pa.array([len(s) for s in sets], pa.int64()), pa.array([bitmap(s) for s in sets], pa.binary())], ["set_id", "text", "n", "bits"])
            yield rows.filter(pa.array(rows.column("set_id").to_numpy() == ids))

    return picked.mapInArrow(check, "set_id long, text string, n long, bits binary").dropDuplicates(["set_id"])


def tiles(hot: DataFrame, picked: DataFrame, share: int, side: int, tile: int) -> DataFrame:
    """Pairs (a, b) between sets outside a list's main component and all its sets whose bitmaps allow a link.

    A pair that meets in several lists leaves the first one only, as far as the ``FIRST`` smallest lists
    of its sets tell: if these have a list in common, the smallest one is the first of all.
    """

    def match(t: pa.Table) -> pa.Table:
        key = t.column("key")[0].as_py()
        ids, n = t.column("set_id").to_numpy(), t.column("n").to_numpy()
        root, main, outer = t.column("root").to_numpy(), t.column("main").to_numpy(), t.column("outer").to_numpy()
        bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(t.num_rows, -1)
        lists = [set(x) for x in t.column("lists").to_pylist()]
        others = np.flatnonzero(~outer)
        left, right = [], []
        for x in np.flatnonzero(outer).tolist():
            # two sets outside the main component meet once
            y = others[(root[others] != root[x]) & ((root[others] == main[x]) | (ids[others] > ids[x]))]
            y = y[100 * np.minimum(n[y], n[x]) >= share * np.maximum(n[y], n[x])]
            both = n[y] + n[x]
            differ = np.bitwise_count(bits[y] ^ bits[x]).sum(1, dtype=np.int64)
            for i in y[(100 + share) * (both - differ) >= 2 * share * both].tolist():
                if min(lists[x] & lists[i], default=key) == key:
                    left.append(min(ids[x], ids[i]))
                    right.append(max(ids[x], ids[i]))
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    lists = hot.groupBy("set_id").agg(F.slice(F.array_sort(F.collect_set("key")), 1, FIRST).alias("lists"))
    sets = cut_lineage(lists.join(picked.select("set_id", "n", "bits"), "set_id"))
    deal = lambda salt, pieces: F.pmod(F.xxhash64("set_id", F.lit(salt)), pieces)
    placed = hot.withColumn("_o", F.ceil(F.col("rest") / side)).withColumn("_i", F.ceil(F.col("m") / tile))
    upto = lambda pieces: F.explode(F.sequence(F.lit(0).cast("long"), F.col(pieces) - 1))
    outer = placed.where("root <> main").select("key", "set_id", "root", "main", F.lit(True).alias("outer"), deal(1, F.col("_o")).alias("x"), upto("_i").alias("y"))
    inner = placed.select("key", "set_id", "root", "main", F.lit(False).alias("outer"), upto("_o").alias("x"), deal(2, F.col("_i")).alias("y"))
    rows = outer.unionByName(inner).join(sets, "set_id")
    return rows.groupBy("key", "x", "y").applyInArrow(match, "a long, b long")


def _split(listed: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (key, set_id, root, main, m, rest) of lists with several components: m sets, rest outside the main one."""
    rows = listed.join(roots, F.col("set_id") == F.col("node"), "left").select("key", "set_id", F.coalesce("root", "set_id").alias("root"))
    rows = cut_lineage(rows.coalesce(max(4, roots.sparkSession.sparkContext.defaultParallelism)))
    main = rows.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("m"), (F.sum("n") - F.max("n")).alias("rest"), F.count("*").alias("parts"))
    return cut_lineage(spread_join(rows, main.where("parts > 1").drop("parts"), "key", "inner"))


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) that stay: the smallest doc_id of each component; repeats of a row go.

    Rows without a doc_id cannot be told apart: they stay if any of them is in a component without ids.
    """
    stay = jaccard_components(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_stay")).distinct()
    left = docs.join(stay, docs.doc_id.cast("long").eqNullSafe(F.col("_stay")), "left_semi")
    return left.withColumn("_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "_hash"]).drop("_hash")

"""Prefix trie of conversations: ternary search trees per range shard, merged at the shard borders.

1. *Dictionary.*  A turn (role, text) gets a 64-bit id; a table of all ids proves that no two different
   turns share one (compared by a second 64-bit fingerprint), or another seed is taken.
2. *Paths.*  A conversation is its array of ids.  Equal paths are counted before anything is sorted, and
   the SHA-256 of their members runs over ids that are packed in pieces, in order, piece by piece.
3. *Shards.*  Distinct paths are dealt by ranges.  A shard builds one ternary search tree: the middle
   path first, then the middles of both halves, so that the search trees among the children of a node
   are balanced.  Nodes are kept in arrays; one pass from the last made to the first adds up members,
   leaves and savings, without recursion.
4. *Borders.*  Only nodes on the first or last path of a shard can lie in two shards.  Those that do are
   added up by the fingerprint of their path, and what was counted more than once (a leaf that goes on in
   the next shard, a child of two shards, the one copy that is not saved) is taken off along their own
   small tree, which has at most one shared path per border.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidebar.operators.heavy import spread_join
from tidebar.session import cut_lineage

SHARD = 25_000  # turns of distinct paths in a shard
PIECE = 4096  # consecutive conversation ids packed into one row
FEW = 1_000_000  # border nodes that are broadcast at most
SEEDS = 8
HEAD = 5  # turns of the first conversation of a hundred that others may take over
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = "edge binary, above binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, size long"


def encode_turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, id, size (code points) per turn; equal ids mean equal (role, text)."""
    text = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = text.where("conv_id IS NOT NULL")
    for seed in range(SEEDS):
        coded = cut_lineage(text.select("conv_id", "turn", F.xxhash64(F.lit(2 * seed), "role", "text").alias("id"), F.xxhash64("text", "role", F.lit(2 * seed + 1)).alias("proof"), F.char_length("text").cast("long").alias("size")))
        clash = coded.groupBy("id").agg(F.min("proof").alias("a"), F.max("proof").alias("b")).where("a <> b")
        if clash.isEmpty():
            return coded.select("conv_id", "turn", "id", "size")
    raise ValueError("no seed gives every turn its own id")


def rebuilt(coded: DataFrame) -> DataFrame:
    """conv_id, ids, sizes: every conversation with the first turns of its hundred in place of its own."""
    turn = F.sort_array(F.collect_list(F.struct("turn", "id", "size")))  # null comes first
    whole = coded.groupBy("conv_id").agg(turn.alias("t"))
    whole = cut_lineage(whole.select("conv_id", F.col("t.id").alias("ids"), F.col("t.size").alias("sizes")))
    heads = whole.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.slice("ids", 1, HEAD).alias("hids"), F.slice("sizes", 1, HEAD).alias("hsizes"))
    h = (F.crc32(F.col("conv_id").cast("string")) % (HEAD + 1)).cast("int")
    both = whole.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).withColumn("h", h).join(heads, "base", "left")
    none = F.array().cast("array<long>")
    put = lambda own, head: F.concat(F.slice(F.coalesce(head, none), F.lit(1), F.col("h")), F.slice(own, F.col("h") + 1, F.greatest(F.size(own), F.lit(1))))
    return both.select("conv_id", put("ids", F.col("hids")).alias("ids"), put("sizes", F.col("hsizes")).alias("sizes"))


def distinct_paths(convs: DataFrame) -> DataFrame:
    """ids, sizes, n, conv_id (smallest), ends_sha256: one row per distinct path of (conv_id, ids, sizes)."""

    def digest(batches):
        """SHA-256 of the ids of each path; a path's pieces follow each other in order."""
        now, sha, out = None, None, []
        for rows in batches:
            for a, b, members in zip(rows.column("f").to_pylist(), rows.column("g").to_pylist(), rows.column("members").to_pylist()):
                text = ",".join(map(str, members)).encode()
                if (a, b) == now:
                    sha.update(b"," + text)
                    continue
                if now is not None:
                    out.append((*now, sha.hexdigest()))
                now, sha = (a, b), hashlib.sha256(text)
            yield packed(out)
            out = []
        if now is not None:
            yield packed([(*now, sha.hexdigest())])

    def packed(out):
        f, g, s = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(f, pa.int64()), pa.array(g, pa.int64()), pa.array(s, pa.string())], ["f", "g", "ends_sha256"])

    keyed = cut_lineage(convs.withColumn("f", F.xxhash64("ids")).withColumn("g", F.xxhash64(F.lit(1), F.size("ids"), "ids")))
    paths = keyed.groupBy("f", "g").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.first("ids").alias("ids"), F.first("sizes").alias("sizes"))
    piece = keyed.groupBy("f", "g", F.floor(F.col("conv_id") / PIECE).alias("piece")).agg(F.sort_array(F.collect_list("conv_id")).alias("members"))
    ends = piece.repartition("f", "g").sortWithinPartitions("f", "g", "piece").select("f", "g", "members").mapInArrow(digest, "f long, g long, ends_sha256 string")
    return paths.join(ends, ["f", "g"]).drop("f", "g")


class Tree:
    """A ternary search tree over sorted paths; node 0 is the textless root."""

    def __init__(self):
        self.key, self.low, self.high, self.down, self.up, self.size, self.depth = [0], [0], [0], [0], [-1], [0], [0]

    def add(self, path, sizes) -> list[int]:
        """Walk or grow the nodes of a path; returns them from the root on."""
        key, low, high, down = self.key, self.low, self.high, self.down
        at, nodes = 0, [0]
        for turn, size in zip(path, sizes):
            links, slot = down, at
            while True:
                node = links[slot]
                if not node:
                    node = len(key)
                    links[slot] = node
                    key.append(turn)
                    low.append(0)
                    high.append(0)
                    down.append(0)
                    self.up.append(at)
                    self.size.append(size)
                    self.depth.append(len(nodes))
                    break
                if turn == key[node]:
                    break
                links, slot = (low if turn < key[node] else high), node
            at = node
            nodes.append(at)
        return nodes


def middles(n: int):
    """0..n-1, the middle first, then the middles of the halves, and so on."""
    ranges = [(0, n)]
    for a, b in ranges:
        if a < b:
            mid = (a + b) // 2
            yield mid
            ranges.append((a, mid))
            ranges.append((mid + 1, b))


def marks(path) -> list[bytes]:
    """A 128-bit fingerprint of every prefix of a path, the empty one first."""
    run = hashlib.blake2b(digest_size=16)
    out = [run.digest()]
    for turn in path:
        run.update(int(turn).to_bytes(8, "little", signed=True))
        out.append(run.copy().digest())
    return out


def shard_nodes(rows: pa.Table) -> pa.RecordBatch:
    """Nodes of one shard (columns of NODE); ``edge`` names those that another shard may hold too."""
    paths, sizes = rows.column("ids").to_pylist(), rows.column("sizes").to_pylist()
    order = sorted(range(len(paths)), key=paths.__getitem__)
    tree, last = Tree(), {}
    for i in middles(len(order)):
        last[order[i]] = tree.add(paths[order[i]], sizes[order[i]])[-1]
    n = len(tree.key)
    members, first, ends = [0] * n, [None] * n, [EMPTY] * n
    for i, (count, conv, sha) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("n", "conv_id", "ends_sha256")))):
        members[last[i]], first[last[i]], ends[last[i]] = count, conv, sha
    children, leaves, saved = [0] * n, [0] * n, [0] * n
    for v in range(n - 1, -1, -1):  # a node is made after the one above it
        if not children[v]:
            leaves[v] = 1
        saved[v] += (members[v] - 1) * tree.size[v]
        up = tree.up[v]
        if up >= 0:
            members[up] += members[v]
            first[up] = first[v] if first[up] is None else min(first[up], first[v])
            children[up] += 1
            leaves[up] += leaves[v]
            saved[up] += saved[v]
    edge, above = [None] * n, [None] * n
    for i in {order[0], order[-1]}:
        for v, mark in zip(tree.add(paths[i], sizes[i]), marks(paths[i])):
            edge[v] = mark
    for v in range(1, n):
        above[v] = edge[tree.up[v]]
    parent = [None] + [first[u] for u in tree.up[1:]]
    columns = [edge, above, first, tree.depth, parent, members, children, leaves, saved, ends, tree.size]
    kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in NODE.split(", ")])


def grow(batches):
    """One tree per range shard."""
    rows = [b for b in batches if b.num_rows]
    if rows:
        out = shard_nodes(pa.Table.from_batches(rows))
        for at in range(0, out.num_rows, 20_000):
            yield out.slice(at, 20_000)


def settle(batches):
    """Take what several shards counted off the shared nodes and all nodes above them.

    ``shared`` rows: edge, above, depth, n_convs, shards, n_children, bare (shards where it has no child),
    n_leaves, saved_tokens, size.  There is at most one path of them per border between two shards.
    """
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    t = pa.Table.from_batches(rows)
    at = {k: i for i, k in enumerate(t.column("edge").to_pylist())}
    up = [at.get(k) for k in t.column("above").to_pylist()]
    depth, shards, bare, size = (t.column(c).to_pylist() for c in ("depth", "shards", "bare", "size"))
    children, leaves, saved = (t.column(c).to_pylist() for c in ("n_children", "n_leaves", "saved_tokens"))
    less, more = [0] * len(depth), [0] * len(depth)
    for v in sorted(range(len(depth)), key=lambda i: -depth[i]):
        less[v] += bare[v] - (bare[v] == shards[v])  # a leaf of one shard that goes on in another, or a leaf of several
        more[v] += (shards[v] - 1) * size[v]
        leaves[v] -= less[v]
        saved[v] += more[v]
        if up[v] is not None:
            children[up[v]] -= shards[v] - 1
            less[up[v]] += less[v]
            more[up[v]] += more[v]
    for name, values in (("n_children", children), ("n_leaves", leaves), ("saved_tokens", saved)):
        t = t.set_column(t.schema.get_field_index(name), name, pa.array(values, pa.int64()))
    yield from t.select(["edge", "n_children", "n_leaves", "saved_tokens"]).combine_chunks().to_batches()


def prefix_nodes(convs: DataFrame, shard: int = SHARD) -> DataFrame:
    """The nodes of the trie over (conv_id, ids, sizes): see ``conversation_trie``."""
    paths = cut_lineage(distinct_paths(convs))
    turns = paths.agg(F.sum(F.size("ids").cast("long"))).first()[0] or 0
    dealt = paths.repartitionByRange(max(1, turns // shard), "ids")
    nodes = cut_lineage(dealt.mapInArrow(grow, NODE))

    # borders: nodes of several shards, added up and corrected
    edges = nodes.where("edge IS NOT NULL").groupBy("edge").agg(
        F.first("above").alias("above"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.count("*").alias("shards"),
        F.sum("n_children").alias("n_children"), F.sum((F.col("n_children") == 0).cast("long")).alias("bare"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
        F.max(F.when(F.col("ends_sha256") != EMPTY, F.col("ends_sha256"))).alias("ends"), F.first("size").alias("size"))
    shared = cut_lineage(edges.where("shards > 1"))
    fixed = shared.select("edge", "above", "depth", "shards", "bare", "size", "n_children", "n_leaves", "saved_tokens").coalesce(1).mapInArrow(settle, "edge binary, n_children long, n_leaves long, saved_tokens long")
    shared = cut_lineage(shared.drop("n_children", "n_leaves", "saved_tokens").join(fixed, "edge"))
    few = shared.count() <= FEW

    # a node of one shard whose parent is shared takes the parent's conversation from there
    tops = shared.select(F.col("edge").alias("above"), F.col("conv_id").alias("_top"))
    plain = nodes.join(F.broadcast(shared.select("edge")) if few else shared.select("edge"), "edge", "left_anti")
    body = plain.select("above", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    border = shared.select("above", "conv_id", "depth", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"))
    out = body.unionByName(border)
    out = out.join(F.broadcast(tops), "above", "left") if few else spread_join(out, tops, "above", "left")
    return out.select("conv_id", "depth", F.coalesce("_top", "parent_conv_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(rows: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row per distinct beginning of the rebuilt conversations of (conv_id, turn, role, text).

    conv_id (smallest member), depth, parent_conv_id (the parent's conv_id; null at the root), n_convs,
    n_children, n_leaves (childless nodes of the subtree, itself included), saved_tokens (over the subtree:
    members less one times the code points of a node's last text) and ends_sha256 (SHA-256 of the
    comma-joined ascending conv_ids that end here; of the empty string where none does).

    Turns are ordered by number, null first; turns of one conversation with the same number follow the
    order of their dictionary ids, repeated ones stand next to each other.  A null role or text is empty.
    Rows without a conv_id belong to no conversation.  A conversation whose turns are all replaced by
    none is a member of the root only.  An empty table has no nodes.  Other columns are ignored.

    Texts never leave the first pass: 16 bytes a turn are sorted and shuffled.  The ids of one
    conversation are held by one task; copies and shared beginnings, however many, are not.
    """
    return prefix_nodes(rebuilt(encode_turns(rows)), shard)

"""Exact duplicates by composable polynomial fingerprints.

A text is cut into chunks.  Each chunk gets a polynomial value modulo two primes and the factor
that its length shifts a value in front of it by, so chunk values combine in any grouping:
``value(a + b) = value(a) * shift(b) + value(b)``.  Texts of one chunk never leave their row;
the chunk values of longer texts are combined per document by length-shifted arithmetic.

Equal (length, values) only makes two texts candidates.  Every candidate is then compared chunk by
chunk with the text of its class's representative; those that differ form the next round's classes,
so results do not rest on the fingerprints.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidebar.llm.textbatch import slices
from tidebar.session import cut_lineage

# Two primes below 2^31 and a base for each
PRIMES = (2147483647, 2147483629)
BASES = (1000003, 998244353 % 2147483629)
CHUNK = 1 << 20  # bytes
COMPARE = 1 << 16  # characters compared at once
SHARE = 512  # members that share one copy of a representative's text


_POWERS: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base**(n-1) .. base**0 modulo prime for a power of two n, by doubling; the longest is kept."""
    held = _POWERS.get((base, prime))
    if held is None or len(held) < n:
        out, step = np.ones(1, np.int64), base % prime
        while len(out) < n:
            out = np.concatenate([out, out * step % prime])
            step = step * step % prime
        held = _POWERS[base, prime] = np.ascontiguousarray(out[::-1])
    return held[len(held) - n :]


def chunk_values(data: bytes, primes=PRIMES) -> tuple[int, int, int, int]:
    """Value and shift of a chunk for each prime."""
    digits = np.frombuffer(data, np.uint8).astype(np.int64) + 1
    out = []
    for base, prime in zip(BASES, primes):
        size = 1 << max(0, (len(data) - 1).bit_length())
        weights = _powers(base, prime, size)[size - len(data) :]
        out += [int(np.dot(digits, weights) % prime), pow(base, len(data), prime)]
    return tuple(out)


def chunk_table(docs: DataFrame, chunk: int = CHUNK, primes=PRIMES) -> DataFrame:
    """One row per chunk: row_id, doc_id, no, last, n_bytes, v1, s1, v2, s2."""

    def run(batches):
        for rows, texts in slices(batches):
            out = {k: [] for k in ("doc_id", "hash", "no", "n_bytes", "v1", "s1", "v2", "s2", "chunks")}
            for i, h, t in zip(rows.column("doc_id").to_pylist(), rows.column("hash").to_pylist(), texts):
                count = max(1, -(-len(t) // chunk))
                for no in range(count):
                    part = t[no * chunk : (no + 1) * chunk]
                    for k, v in zip(out, (i, h, no, len(part), *chunk_values(part, primes), count)):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("hash", pa.string()), ("no", pa.int64()), ("n_bytes", pa.int64())] + [(k, pa.int64()) for k in ("v1", "s1", "v2", "s2", "chunks")])
    ddl = "doc_id long, hash string, no long, n_bytes long, v1 long, s1 long, v2 long, s2 long, chunks long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "hash").mapInArrow(run, ddl)


def fingerprints(docs: DataFrame, chunk: int = CHUNK, primes=PRIMES) -> DataFrame:
    """doc_id, text_sha256, n_bytes, f1, f2: one row per distinct (doc_id, text)."""
    texts = docs.select("doc_id", "text", F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("hash"))
    parts = cut_lineage(chunk_table(texts, chunk, primes))
    one = parts.where("chunks = 1").select("doc_id", F.col("hash").alias("text_sha256"), "n_bytes", F.col("v1").alias("f1"), F.col("v2").alias("f2"))
    p1, p2 = (F.lit(p).cast("long") for p in primes)
    many = (
        parts.where("chunks > 1")
        .groupBy("doc_id", "hash")
        .agg(F.array_sort(F.collect_set(F.struct("no", "n_bytes", "v1", "s1", "v2", "s2"))).alias("cs"))
        .select(
            "doc_id",
            F.col("hash").alias("text_sha256"),
            F.aggregate("cs", F.lit(0).cast("long"), lambda a, c: a + c["n_bytes"]).alias("n_bytes"),
            F.aggregate("cs", F.lit(0).cast("long"), lambda a, c: (a * c["s1"] + c["v1"]) % p1).alias("f1"),
            F.aggregate("cs", F.lit(0).cast("long"), lambda a, c: (a * c["s2"] + c["v2"]) % p2).alias("f2"),
        )
    )
    return one.unionByName(many)


def exact_dedup(docs: DataFrame, chunk: int = CHUNK, compare: int = COMPARE, primes=PRIMES) -> DataFrame:
    """Classes of equal texts: doc_id, keep_id, group_size, kept, text_sha256, n_bytes.

    Null text counts as empty.  Of equal texts the largest doc_id stays (a null doc_id only where
    the class has no other).  Rows that repeat both doc_id and text are one document and give one
    row; rows that share only a doc_id are documents of their own.  An empty table gives no rows;
    other columns of ``docs`` are ignored.
    """
    prints = cut_lineage(fingerprints(docs, chunk, primes).dropDuplicates(["doc_id", "text_sha256"]))
    key = ["n_bytes", "f1", "f2"]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("text_sha256", F.sha2("text", 256))
    done, pending = None, prints
    while True:
        # the representative is the one that would stay; struct order puts a null doc_id first
        group = pending.groupBy(*key).agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "text_sha256")).alias("rep"))
        members = cut_lineage(pending.join(group, key))
        doubtful = members.where("n > 1")
        differ = compared(doubtful, texts, key, compare)
        checked = cut_lineage(doubtful.join(differ, [doubtful.doc_id.eqNullSafe(differ.d_id), doubtful.text_sha256 == differ.d_hash], "left").withColumn("same", F.col("d_id").isNull() & F.col("d_hash").isNull()).drop("d_id", "d_hash"))
        alike = checked.where("same")
        settled = members.where("n = 1").select("doc_id", "text_sha256", "n_bytes", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
        sizes = alike.groupBy(*key).agg(F.count("*").alias("group_size"))
        settled = settled.unionByName(alike.join(sizes, key).select("doc_id", "text_sha256", "n_bytes", F.col("rep.doc_id").alias("keep_id"), "group_size"))
        done = settled if done is None else done.unionByName(settled)
        pending = checked.where("not same").select("doc_id", "text_sha256", *key)
        if pending.isEmpty():
            break
    return done.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "n_bytes")


def compared(members: DataFrame, texts: DataFrame, key: list[str], compare: int) -> DataFrame:
    """d_id, d_hash of the members whose text is not the representative's.

    Both texts are cut into pieces and joined piece by piece.  A large class is dealt over copies
    of its representative, one per ``SHARE`` members, so no join key is hot.
    """
    pieces = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("text") - 1) / compare)).cast("int")),
        lambda i: F.struct(i.alias("no"), F.substring(F.col("text"), i * compare + 1, F.lit(compare)).alias("piece")),
    )
    copies = F.ceil(F.col("n") / SHARE)
    whole = members.join(texts, [members.doc_id.eqNullSafe(texts.doc_id), members.text_sha256 == texts.text_sha256])
    whole = cut_lineage(whole.select(members.doc_id.alias("d_id"), members.text_sha256.alias("d_hash"), "n", "rep", *key, "text"))
    mine = whole.select("d_id", "d_hash", *key, F.pmod(F.xxhash64("d_id", "d_hash"), copies).alias("share"), F.explode(pieces).alias("p"))
    mine = mine.select("d_id", "d_hash", *key, "share", F.col("p.no").alias("no"), F.col("p.piece").alias("piece"))
    reps = whole.where(F.col("d_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("d_hash") == F.col("rep.text_sha256")))
    reps = reps.select(*key, "n", F.explode(pieces).alias("r")).select(*key, "r", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("share"))
    reps = reps.select(*key, "share", F.col("r.no").alias("no"), F.col("r.piece").alias("rep_piece"))
    pairs = mine.join(reps, [*key, "share", "no"], "left")
    return pairs.where(~F.col("piece").eqNullSafe(F.col("rep_piece"))).select("d_id", "d_hash").distinct()


def keep_last(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) whose text is not repeated by a larger doc_id; repeats of a row go."""
    kept = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("_keep_id"), F.col("text_sha256").alias("_keep_hash"))
    rows = docs.withColumn("_hash", F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    left = rows.join(kept, [rows.doc_id.cast("long").eqNullSafe(kept["_keep_id"]), rows["_hash"] == kept["_keep_hash"]], "left_semi")
    return left.dropDuplicates(["doc_id", "_hash"]).drop("_hash")

"""Repeated word passages by super-k-mer partitioning.

The leading minimiser of a window of ``WINDOW`` words is the smallest hash of its runs of ``GRAM``
words.  Consecutive windows with the same minimiser travel as one packed string (a super-k-mer) to
the bucket of that minimiser, so equal windows always meet; there sorting groups the windows
exactly: equal fingerprints are confirmed on the words themselves.

Before anything is shuffled, windows that repeat a smaller document of the same batch are settled
on the spot, so a group of copies sends each window once per batch.  A counting pass finds
minimisers that lead too many runs (words of a line that a third of all documents hold); they rank
behind all others, so such runs spread over the minimisers of what surrounds them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tidebar.llm.anchors import frequent, lead_rows, order_of, run_starts, sliding_min
from tidebar.llm.textbatch import Words, mix, ngram_hashes, slices
from tidebar.session import cut_lineage

WINDOW = 50  # words
GRAM = 4  # words of a minimiser
BATCH = 4 << 20  # bytes of text settled together before the shuffle
BUCKET = 4 << 20  # bytes of input text per bucket (super-k-mers overlap, so a bucket holds about three times that)
LEADS = 10_000  # a minimiser that leads more than one in so many runs is frequent
NO_ID = np.iinfo(np.int64).max  # stands for a null doc_id: larger than any other


class Batch:
    """Windows of some documents, with those settled that repeat a smaller document among them."""

    def __init__(self, texts: list[bytes], ids: np.ndarray, window: int, settle: bool = True):
        self.words, self.window = Words(texts), window
        w = self.words
        self.at = np.flatnonzero(w.left >= window)  # word index of every window
        self.doc = w.doc[self.at]
        self.ids = ids
        self.settled = np.zeros(len(self.at), bool)
        if settle and len(self.at):
            self.key = ngram_hashes(w.hashes, window)[self.at]
            self.settled = repeats(w, self.at, self.key, ids[self.doc], window)

    def leads(self, gram: int, hot: np.ndarray) -> np.ndarray:
        order = order_of(mix(ngram_hashes(self.words.hashes, gram)), hot)
        return sliding_min(order, self.window - gram + 1)[self.at]

    def runs(self, which: np.ndarray, *same: np.ndarray) -> list[tuple[int, int]]:
        """Index ranges of consecutive chosen windows of one document that agree in ``same``."""
        index = np.flatnonzero(which)
        if not len(index):
            return []
        first = run_starts(index - np.arange(len(index)), self.doc[index], *(s[index] for s in same))
        return list(zip(index[first].tolist(), (index[np.append(first[1:], len(index)) - 1] + 1).tolist()))


def repeats(words: Words, at: np.ndarray, key: np.ndarray, ids: np.ndarray, window: int) -> np.ndarray:
    """Which windows also start in a document with a smaller id.

    Windows are sorted by fingerprint and id; every one is compared word by word with the first of
    its fingerprint.  Neighbouring windows are compared in one stretch.  Where a fingerprint turns
    out to stand for different words, its windows are grouped by the words.
    """
    order = np.lexsort((at, ids, key))
    first = run_starts(key[order])
    lead = np.empty(len(at), np.int64)
    lead[order] = np.repeat(order[first], np.diff(np.append(first, len(order))))
    out = ids[lead] < ids
    check = np.flatnonzero(lead != np.arange(len(at)))
    if not len(check):
        return out
    stretch = run_starts(at[check] - np.arange(len(check)), at[lead[check]] - at[check])
    bad: set[int] = set()
    for a, b in zip(check[stretch].tolist(), check[np.append(stretch[1:], len(check)) - 1].tolist()):
        if words.span(at[a], at[b] + window) != words.span(at[lead[a]], at[lead[b]] + window):
            bad.update(key[a : b + 1].tolist())
    if bad:
        again = np.flatnonzero(np.isin(key, np.array(sorted(bad), np.uint64)))
        least: dict[bytes, int] = {}
        for i in again.tolist():
            s = words.span(at[i], at[i] + window)
            least[s] = min(least.get(s, NO_ID), int(ids[i]))
        for i in again.tolist():
            out[i] = least[words.span(at[i], at[i] + window)] < ids[i]
    return out


def ids_of(rows: pa.RecordBatch) -> np.ndarray:
    return rows.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def repeated_ranges(docs: DataFrame, window: int, gram: int, batch: int, bucket: int, leads: int) -> DataFrame:
    """doc_id, h, first, n: ranges of n windows from word ``first`` on that repeat a smaller document."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, (max(1, total // bucket) - 1).bit_length())
    buckets = 1 << bits
    none = np.zeros(0, np.uint64)

    def counted(batches):
        for rows, texts in slices(batches, limit=batch):
            b = Batch(texts, ids_of(rows), window, settle=False)
            lead = b.leads(gram, none)
            starts = [a for a, _ in b.runs(~b.settled, lead)]
            yield lead_rows(lead[starts])

    hot = spark.sparkContext.broadcast(frequent(docs.mapInArrow(counted, "value long, runs long"), leads))

    def sent(batches):
        no = 0
        for rows, texts in slices(batches, limit=batch):
            ids, hashes = ids_of(rows), rows.column("h").to_numpy()
            b = Batch(texts, ids, window)
            out = []
            done = b.runs(b.settled)
            if done:
                out.append((buckets + no % buckets, meta(b, done, ids, hashes), b""))
            lead = b.leads(gram, hot.value)
            runs = b.runs(~b.settled, lead)
            if runs:
                value = mix(lead[[a for a, _ in runs]])
                where = (value >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(runs), np.int64)
                order = np.argsort(where, kind="stable")
                cut = run_starts(where[order])
                for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(order)]):
                    some = [runs[k] for k in order[i:j].tolist()]
                    packed = b"\n".join([b.words.span(b.at[x], b.at[y - 1] + window) for x, y in some])
                    out.append((int(where[order[i]]), meta(b, some, ids, hashes), zstandard.compress(packed, 3)))
            no += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary()))], ["bucket", "meta", "packed"])

    def met(table: pa.Table) -> pa.Table:
        found = np.concatenate([np.frombuffer(zstandard.decompress(m), np.int64).reshape(-1, 4) for m in table.column("meta").to_pylist()])
        if table.column("bucket")[0].as_py() < buckets:
            strings = [s for p in table.column("packed").to_pylist() for s in zstandard.decompress(p).split(b"\n")]
            words = Words(strings)
            at = np.flatnonzero(words.left >= window)
            string = words.doc[at]
            again = np.flatnonzero(repeats(words, at, ngram_hashes(words.hashes, window)[at], found[string, 0], window))
            if len(again):
                first = run_starts(again - np.arange(len(again)), string[again])
                n = np.diff(np.append(first, len(again)))
                inside = at[again[first]] - words.first[string[again[first]]]
                found = found[string[again[first]]]
                found[:, 2] += inside
                found[:, 3] = n
            else:
                found = found[:0]
        return pa.table({c: np.ascontiguousarray(found[:, k]) for k, c in enumerate(("doc_id", "h", "first", "n"))})

    return docs.mapInArrow(sent, "bucket int, meta binary, packed binary").groupBy("bucket").applyInArrow(met, "doc_id long, h long, first long, n long")


def meta(b: Batch, runs: list[tuple[int, int]], ids: np.ndarray, hashes: np.ndarray) -> bytes:
    """(doc_id, text hash, first word, windows) of each run."""
    a, z = np.array(runs, np.int64).T
    doc = b.doc[a]
    return zstandard.compress(np.stack([ids[doc], hashes[doc], b.at[a] - b.words.first[doc], z - a], axis=1).tobytes(), 1)


def with_row_key(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and a hash that tells rows of one doc_id apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))


def with_ranges(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each row with the list of its ranges (null: none)."""
    lists = ranges.groupBy("doc_id", "h").agg(F.collect_list(F.struct("first", "n")).alias("ranges"))
    lists = lists.select(F.col("doc_id").alias("k"), F.col("h").alias("kh"), "ranges")
    return rows.join(lists, (F.coalesce("doc_id", F.lit(int(NO_ID))) == F.col("k")) & (F.col("h") == F.col("kh")), "left").select("doc_id", "text", "ranges")


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batch: int = BATCH, bucket: int = BUCKET, leads: int = LEADS) -> DataFrame:
    """doc_id, n_words, n_removed, kept: every document without the words of repeated passages.

    A word goes if a run of ``window`` words that covers it also starts in a document with a smaller
    doc_id, whatever else of that document goes; ``kept`` joins what stays by single spaces.  Null
    texts have no words; shorter texts stay whole; a passage repeated only inside one document
    stays.  Rows that share a doc_id count as one document's parts: they don't repeat each other.  A
    null doc_id counts as larger than any other.  One row per row of ``docs``; an empty table gives
    none; other columns are ignored.
    """
    rows = with_row_key(docs)
    ranges = cut_lineage(repeated_ranges(rows, window, gram, batch, bucket, leads))

    def kept(batches):
        for part, texts in slices(batches):
            out = {k: [] for k in ("n_words", "n_removed", "kept")}
            for text, spans in zip(texts, part.column("ranges").to_pylist()):
                words = text.split()
                if spans:
                    edge = np.zeros(len(words) + 1, np.int64)
                    for s in spans:
                        edge[s["first"]] += 1
                        edge[s["first"] + s["n"] + window - 1] -= 1
                    stay = np.flatnonzero(np.cumsum(edge)[:-1] == 0)
                    left = [words[i] for i in stay.tolist()]
                else:
                    left = words
                for k, v in zip(out, (len(words), len(words) - len(left), b" ".join(left))):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept"], pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return with_ranges(rows, ranges).mapInArrow(kept, "doc_id long, n_words long, n_removed long, kept string")

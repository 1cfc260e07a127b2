"""Repeated byte strings by external sorting of anchors and induced sorting of suffixes in memory.

A position is sampled where the hash of its ``GRAM`` bytes is the smallest of a window of
``WINDOW`` bytes (its anchor).  Windows with the same anchor travel together, with their bytes, to
the bucket of the anchor's hash, so equal windows meet, with the anchor at the same offset.

A bucket sorts the suffixes that start at its anchors with a priority queue on disk: sorted runs are
written to the task's temporary folder and merged, so a bucket may be far larger than memory.  The
queue yields suffix tuples in order; only this sort of the anchors is external.  Stretches of the
sorted tuples that share an anchor are then worked on in memory, without a bound but the shared
anchor: common prefixes of neighbours come from their bytes, and from them the order and common
prefixes of the suffixes that start one byte earlier are induced (a stable pass over the preceding
bytes; the common prefix is one more than the least between the two before), and so on until the
first window of every anchor is reached.  At each step the windows that start there are equal
exactly where the common prefix spans the window.

Windows repeated inside a batch are settled before the shuffle, and anchors that are too frequent
rank behind all others, as in ``substring_dedup``.
"""

from __future__ import annotations

import heapq
import pickle
import tempfile
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tidebar.llm.anchors import frequent, lead_rows, run_starts
from tidebar.llm.substring_dedup import ids_of, with_ranges, with_row_key
from tidebar.llm.textbatch import mix, ngram_hashes, slices
from tidebar.session import cut_lineage

WINDOW = 100  # bytes, at most 255
GRAM = 16  # bytes of an anchor
BATCH = 2 << 20  # bytes of text settled together before the shuffle
BUCKET = 5 << 20  # bytes of input text per bucket (the windows sent there are about three times that)
LEADS = 10_000  # an anchor that leads more than one in so many runs is frequent
QUEUE = 60_000  # suffix tuples held in memory before a sorted run goes to disk
INDUCE = 60_000  # anchors that are induced together; more only if they share their first bytes
SAMPLE = (64, 1024)  # texts, and characters of each, in the compression dictionary
OFFSET = np.uint64(127)
FREQUENT = np.uint64(1 << 63)


class Batch:
    """Windows of some documents in order of precedence, with those settled that repeat an earlier one."""

    def __init__(self, texts: list[bytes], ids: np.ndarray, hashes: np.ndarray, window: int, settle: bool = True):
        order = np.lexsort((hashes, ids))
        order = order[run_starts(ids[order], hashes[order])] if len(order) else order  # repeats of a row are one
        self.ids, self.hashes, self.window = ids[order], hashes[order], window
        self.data = b"".join([texts[i] for i in order.tolist()])
        size = np.array([len(texts[i]) for i in order.tolist()], np.int64)
        self.first = np.cumsum(size) - size
        count = np.maximum(0, size - window + 1)
        self.doc = np.repeat(np.arange(len(size)), count)
        self.at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + self.first[self.doc]
        letters = mix(np.arange(256, dtype=np.uint64))[np.frombuffer(self.data, np.uint8)]
        self.settled = earlier(self.data, self.at, ngram_hashes(letters, window)[self.at], window) if settle and len(self.at) else np.zeros(len(self.at), bool)
        self.letters = letters

    def anchors(self, gram: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading value and position of the anchor of every window."""
        value = (ngram_hashes(self.letters, gram) >> np.uint64(8)) << np.uint64(7)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, value), len(hot) - 1)
            value[hot[at] == value] |= FREQUENT
        # the offset in the low bits makes the leftmost of equal values the anchor
        size, w = 1, self.window - gram + 1
        while size < w:
            step = min(size, w - size)
            if len(value) > step:
                value[:-step] = np.minimum(value[:-step], value[step:] + np.uint64(step))
            size += step
        value = value[self.at]
        return value & ~OFFSET, self.at + (value & OFFSET).astype(np.int64)

    def runs(self, which: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last window index of every stretch of chosen windows of one document that agree in ``same``."""
        index = np.flatnonzero(which)
        if not len(index):
            return index, index
        first = run_starts(index - np.arange(len(index)), self.doc[index], *(s[index] for s in same))
        return index[first], index[np.append(first[1:], len(index)) - 1]


def repeated(key: np.ndarray) -> np.ndarray:
    """Positions of the keys that occur more than once (sorting values costs far less than sorting positions)."""
    each = np.sort(key)
    twice = np.unique(each[1:][each[1:] == each[:-1]])
    if not len(twice):
        return np.zeros(0, np.int64)
    maybe = np.zeros(1 << 20, bool)
    maybe[twice >> np.uint64(44)] = True
    at = np.flatnonzero(maybe[key >> np.uint64(44)])
    return at[twice[np.minimum(np.searchsorted(twice, key[at]), len(twice) - 1)] == key[at]]


def earlier(data: bytes, at: np.ndarray, key: np.ndarray, window: int) -> np.ndarray:
    """Which windows repeat one before them: by fingerprint, confirmed on the bytes stretch by stretch."""
    again = repeated(key)
    again = again[np.argsort(key[again])]
    out, lead = np.zeros(len(at), bool), np.zeros(len(at), np.int64)
    if len(again):
        first = run_starts(key[again])
        lead[again] = np.repeat(np.minimum.reduceat(again, first), np.diff(np.append(first, len(again))))
        out[again] = lead[again] < again
    check = np.flatnonzero(out)
    if not len(check):
        return out
    stretch = run_starts(at[check] - np.arange(len(check)), at[lead[check]] - at[check])
    bad: set[int] = set()
    for a, b in zip(check[stretch].tolist(), check[np.append(stretch[1:], len(check)) - 1].tolist()):
        if data[at[a] : at[b] + window] != data[at[lead[a]] : at[lead[b]] + window]:
            bad.update(key[a : b + 1].tolist())
    if bad:
        seen = set()
        for i in np.flatnonzero(np.isin(key, np.array(sorted(bad), np.uint64))).tolist():
            s = data[at[i] : at[i] + window]
            out[i] = s in seen
            seen.add(s)
    return out


def pack_meta(meta: np.ndarray) -> bytes:
    """Rows (doc_id, h, first, n, anchor) as byte planes of columns, ids once per run of rows of a document."""
    start = run_starts(meta[:, 0], meta[:, 1])
    flat = np.concatenate([[len(start)], meta[start, 0], meta[start, 1], np.diff(np.append(start, len(meta))), meta[:, 2], meta[:, 3], meta[:, 4]])
    return zstandard.compress(np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack_meta(blob: bytes) -> np.ndarray:
    flat = np.ascontiguousarray(np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1).T).view(np.int64).reshape(-1)
    k = int(flat[0])
    ids, rest = flat[1 : 1 + 3 * k].reshape(3, -1), flat[1 + 3 * k :].reshape(3, -1)
    return np.stack([np.repeat(ids[0], ids[2]), np.repeat(ids[1], ids[2]), *rest], axis=1)


def sample_text(docs: DataFrame) -> bytes:
    """The start of a few texts: only a dictionary for the compression of windows; no result depends on it."""
    found = docs.where("text <> ''").select(F.substring("text", 1, SAMPLE[1]).alias("t")).limit(SAMPLE[0]).collect()
    return b" ".join(r.t.encode() for r in found).ljust(64)


def dictionary(sample: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class DiskQueue:
    """Priority queue of (suffix, ...) tuples: sorted runs on disk, merged when emptied."""

    def __init__(self, most: int):
        self.most, self.held, self.files = most, [], []

    def push(self, items: list[tuple]) -> None:
        self.held += items
        if len(self.held) >= self.most:
            self.held.sort(key=itemgetter(0))
            run = tempfile.TemporaryFile()
            for i in range(0, len(self.held), 2000):
                pickle.dump(self.held[i : i + 2000], run, protocol=5)
            self.files.append(run)
            self.held = []

    @staticmethod
    def _read(run):
        run.seek(0)
        while True:
            try:
                yield from pickle.load(run)
            except EOFError:
                run.close()  # its space on disk is free again
                return

    def drain(self):
        self.held.sort(key=itemgetter(0))
        yield from heapq.merge(*map(self._read, self.files), self.held, key=itemgetter(0))
        self.held, self.files = [], []


def matrix(rows: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join([r.ljust(width, b"\0") for r in rows]), np.uint8).reshape(len(rows), width)


def between(lcp: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Common prefix of each chosen element with the chosen one before it (0 for the first)."""
    out = np.zeros(len(at), lcp.dtype)
    if len(at) > 1:
        out[1:] = np.minimum.reduceat(lcp[: at[-1] + 1], at[:-1] + 1)
    return out


def range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of values[low..high] for many ranges."""
    table = [values]
    while 2 << (len(table) - 1) <= len(values):
        half = 1 << (len(table) - 1)
        last = table[-1]
        table.append(np.concatenate([np.minimum(last[:-half], last[half:]), last[len(last) - half :]]))
    level = np.floor(np.log2(high - low + 1)).astype(np.int64)
    table = np.stack(table)
    return np.minimum(table[level, low], table[level, high - (1 << level) + 1])


def induce(group: list[tuple], window: int) -> np.ndarray:
    """Repeats among the windows of sorted anchors: (doc_id, h, first, n) of each range.

    A tuple is (bytes from the anchor on, bytes before it reversed, doc_id, h, position of the first
    window, number of windows).
    """
    right, left = [g[0] for g in group], [g[1] for g in group]
    doc, h, start, n = np.array([g[2:] for g in group], np.int64).T
    reach = np.array([len(x) for x in left], np.int64)  # offset of the anchor in its first window
    nearest = reach - n + 1  # and in its last
    size = np.array([len(x) for x in right], np.int64)
    r = matrix(right, window)
    lcp = np.zeros(len(group), np.uint8)
    differ = r[1:] != r[:-1]
    lcp[1:] = np.minimum(np.where(differ.any(1), differ.argmax(1), window), np.minimum(size[1:], size[:-1]))
    before = matrix(left, max(1, int(reach.max())))
    rows = np.unique(np.stack([doc, h], axis=1), axis=0, return_inverse=True)[1].reshape(-1)
    order = np.arange(len(group))
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    for back in range(int(reach.max()) + 1):
        here = np.flatnonzero((nearest[order] <= back) & (back <= reach[order]))
        if len(here) > 1:
            who = order[here]
            first = np.flatnonzero(between(lcp, here) < window)
            rank = (rows[who] << 32) + start[who] + reach[who] - back
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(who))))
            again = rank > least
            hits.append((who[again], start[who[again]] + reach[who[again]] - back))
        # on to the suffixes one byte earlier, of anchors that have one and can still match a window
        near = np.maximum(lcp, np.append(lcp[1:], 0)).astype(np.int64)
        on = np.flatnonzero((reach[order] > back) & (near + reach[order] - back >= window))
        if len(on) < 2:
            break
        lcp, order = between(lcp, on), order[on]
        byte = before[order, back]
        to = np.argsort(byte, kind="stable")
        grown = np.zeros(len(to), np.uint8)
        same = np.flatnonzero(byte[to[1:]] == byte[to[:-1]]) + 1
        if len(same):
            grown[same] = np.minimum(range_min(lcp, to[same - 1] + 1, to[same]).astype(np.int64) + 1, window)
        lcp, order = grown, order[to]
    if not hits:
        return np.zeros((0, 4), np.int64)
    who, at = np.concatenate([x for x, _ in hits]), np.concatenate([x for _, x in hits])
    to = np.lexsort((at, who))
    who, at = who[to], at[to]
    first = run_starts(at - np.arange(len(at)), who) if len(at) else np.zeros(0, np.int64)
    return np.stack([doc[who[first]], h[who[first]], at[first], np.diff(np.append(first, len(at)))], axis=1)


def repeated_ranges(docs: DataFrame, window: int, gram: int, batch: int, bucket: int, leads: int, queue: int, together: int) -> DataFrame:
    """doc_id, h, first, n: ranges of n windows from byte ``first`` on that repeat an earlier one."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, (max(1, total // bucket) - 1).bit_length())
    buckets = 1 << bits
    none = np.zeros(0, np.uint64)

    def counted(batches):
        for rows, texts in slices(batches, limit=batch):
            b = Batch(texts, ids_of(rows), rows.column("h").to_numpy(), window, settle=False)
            value, anchor = b.anchors(gram, none)
            yield lead_rows(value[b.runs(~b.settled, anchor)[0]])

    hot = spark.sparkContext.broadcast(frequent(docs.mapInArrow(counted, "value long, runs long"), leads))

    sample = spark.sparkContext.broadcast(sample_text(docs))

    def sent(batches):
        no, packer = 0, zstandard.ZstdCompressor(level=3, dict_data=dictionary(sample.value))
        for rows, texts in slices(batches, limit=batch):
            b = Batch(texts, ids_of(rows), rows.column("h").to_numpy(), window)
            out = []
            a, z = b.runs(b.settled)
            if len(a):
                d = b.doc[a]
                out.append((buckets + no % buckets, zstandard.compress(np.stack([b.ids[d], b.hashes[d], b.at[a] - b.first[d], z - a + 1], axis=1).tobytes(), 1), b""))
            value, anchor = b.anchors(gram, hot.value)
            a, z = b.runs(~b.settled, anchor)
            d = b.doc[a]
            where = (mix(value[a]) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(a), np.int64)
            to = np.argsort(where, kind="stable")
            cut = run_starts(where[to]) if len(to) else to
            meta = np.stack([b.ids[d], b.hashes[d], b.at[a] - b.first[d], z - a + 1, anchor[a] - b.at[a]], axis=1)
            for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(to)]):
                some = to[i:j]
                packed = b"".join([b.data[x : y + window] for x, y in zip(b.at[a[some]].tolist(), b.at[z[some]].tolist())])
                out.append((int(where[to[i]]), pack_meta(meta[some]), packer.compress(packed)))
            no += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary()))], ["bucket", "meta", "packed"])

    def record(found: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, k])) for k in range(4)], ["doc_id", "h", "first", "n"])

    def met(batches):
        """Rows come sorted by bucket; one bucket at a time goes through the queue."""
        waiting, now = DiskQueue(queue), None
        unpacker = zstandard.ZstdDecompressor(dict_data=dictionary(sample.value))
        for rows in batches:
            for at, meta, packed in zip(*(rows.column(c).to_pylist() for c in ("bucket", "meta", "packed"))):
                if at >= buckets:
                    yield record(np.frombuffer(zstandard.decompress(meta), np.int64).reshape(-1, 4))
                    continue
                if now is not None and at != now:
                    yield from map(record, emptied(waiting))
                now = at
                text, items, end = unpacker.decompress(packed), [], 0
                for d, h, first, n, anchor in unpack_meta(meta).tolist():
                    begin, end = end, end + n + window - 1
                    items.append((text[begin + anchor : min(end, begin + anchor + window)], text[begin : begin + anchor][::-1], d, h, first, n))
                waiting.push(items)
        yield from map(record, emptied(waiting))

    def emptied(waiting: DiskQueue):
        """Induced ranges of a bucket, over stretches that end where neighbours don't share an anchor."""
        group: list[tuple] = []
        for item in waiting.drain():
            if len(group) >= together and item[0][:gram] != group[-1][0][:gram]:
                yield induce(group, window)
                group = []
            group.append(item)
        if group:
            yield induce(group, window)

    return docs.mapInArrow(sent, "bucket int, meta binary, packed binary").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(met, "doc_id long, h long, first long, n long")


def suffix_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batch: int = BATCH, bucket: int = BUCKET, leads: int = LEADS, queue: int = QUEUE, together: int = INDUCE) -> DataFrame:
    """doc_id, n_bytes, spans (first, end), kept: every document without the bytes of repeated strings.

    A byte of the UTF-8 text goes if a string of ``window`` bytes that covers it also starts earlier:
    in a smaller doc_id, or in the same document before.  Strings are judged on the input and never
    span documents.  ``spans`` are the maximal removed ranges, ``kept`` the remaining bytes (which
    need not be valid UTF-8).  Null texts are empty; shorter texts stay whole.  A null doc_id counts
    as larger than any other; rows that share a doc_id count as earlier or later by a hash of their
    text, and repeats of a whole row get equal results.  One row per row of ``docs``; an empty table
    gives none; other columns are ignored.
    """
    if not gram <= window <= min(255, gram + 126):
        raise ValueError("window and gram don't fit")
    rows = with_row_key(docs)
    ranges = cut_lineage(repeated_ranges(rows, window, gram, batch, bucket, leads, queue, together))

    def kept(batches):
        for part, texts in slices(batches):
            spans, left = [], []
            for text, found in zip(texts, part.column("ranges").to_pylist()):
                if not found:
                    spans.append([])
                    left.append(text)
                    continue
                edge = np.zeros(len(text) + 1, np.int64)
                np.add.at(edge, [s["first"] for s in found], 1)
                np.add.at(edge, [s["first"] + s["n"] + window - 1 for s in found], -1)
                gone = np.cumsum(edge)[:-1] > 0
                left.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
                turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                spans.append([{"first": a, "end": b} for a, b in turn.reshape(-1, 2).tolist()])
            kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(spans, kind), pa.array(left, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return with_ranges(rows, ranges).mapInArrow(kept, "doc_id long, n_bytes long, spans array<struct<first:long,end:long>>, kept binary")

"""Benchmark passages in documents by multi-pattern search with shift tables.

Patterns are the runs of words of the test items, as bytes with a space at either end.  For each
band of pattern lengths a table says how far a search position may jump after looking at one block
of bytes; a jump of zero leads to a bucket, chosen by the block itself, whose patterns are then
compared directly.  All segments of a slice of text advance together as one array of positions.

Test items are searched in blocks of bounded size, one after the other over the same rows, so any
number of items can be used and no row is shuffled.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidebar.llm.textbatch import ALNUM_LOWER, STEP, Words, slices

WINDOW = 10  # words
BLOCK_BYTES = 1 << 20  # test item text searched for at once; bounds what is broadcast
BITS = 20
SEGMENT = 2048  # search positions that one running position covers
BANDS = ((64, 8), (32, 8), (16, 8), (8, 4), (4, 3), (3, 3))  # shortest pattern, block length


def windows_of(text: bytes, window: int = WINDOW) -> set[bytes]:
    words = text.translate(ALNUM_LOWER).split()
    if not words:
        return set()
    k = min(window, len(words))
    return {b" " + b" ".join(words[i : i + k]) + b" " for i in range(len(words) - k + 1)}


def blocks_at(view: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` bytes in front of each position as a number; ``view`` starts 8 bytes early."""
    return view[ends] >> np.uint64(8 * (8 - size))


def eights(data: bytes) -> np.ndarray:
    """View of the 8 bytes in front of position i at index i."""
    held = np.frombuffer(b"\0" * 8 + data, np.uint8)
    return np.ndarray((len(data) + 1,), np.uint64, buffer=held, strides=(1,))


class Band:
    """Shift table and buckets of the patterns of one range of lengths."""

    def __init__(self, patterns: list[bytes], ids: list[int], size: int):
        self.reach, self.size = min(map(len, patterns)), size
        self.jump = np.full(1 << BITS, self.reach - size + 1, np.int32)
        self.buckets: dict[int, list[tuple[bytes, int]]] = defaultdict(list)
        for p, i in zip(patterns, ids):
            ends = np.arange(size, self.reach + 1)
            found = blocks_at(eights(p), ends, size)
            np.minimum.at(self.jump, self.slot(found), (self.reach - ends).astype(np.int32))
            self.buckets[int(found[-1])].append((p, i))

    def slot(self, blocks: np.ndarray) -> np.ndarray:
        return ((blocks * STEP) >> np.uint64(64 - BITS)).astype(np.int64)

    def search(self, data: bytes, view: np.ndarray) -> list[tuple[int, int]]:
        """(start, pattern) of every occurrence in ``data``."""
        at = np.arange(self.reach, len(data) + 1, SEGMENT)
        stop = np.minimum(at + SEGMENT, len(data) + 1)
        zero = []
        while len(at):
            jump = self.jump[self.slot(blocks_at(view, at, self.size))]
            zero.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        out = []
        ends = np.concatenate(zero) if zero else np.zeros(0, np.int64)
        for end, block in zip(ends.tolist(), blocks_at(view, ends, self.size).tolist()):
            for p, i in self.buckets.get(block, ()):
                if data.startswith(p, end - self.reach):
                    out.append((end - self.reach, i))
        return out


class Matcher:
    """All windows of some test items, ready to be searched for."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        owners = defaultdict(set)
        for item, text in items:
            for p in windows_of((text or "").encode(), window):
                owners[p].add(item)
        patterns = sorted(owners)
        self.owners = [sorted(x for x in owners[p] if x is not None) for p in patterns]
        self.words = np.array([p.count(b" ") - 1 for p in patterns], np.int64)
        self.bands, most = [], 1 << 62
        for least, size in BANDS:
            ids = [i for i, p in enumerate(patterns) if least <= len(p) < most]
            if ids:
                self.bands.append(Band([patterns[i] for i in ids], ids, size))
            most = least

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """First word and pattern of every occurrence inside one text."""
        data = b" " + words.buf.tobytes()
        view = eights(data)
        found = [x for band in self.bands for x in band.search(data, view)]
        if not found or words.n == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        start, pattern = np.array(found, np.int64).T
        first = np.searchsorted(words.starts, start)
        ok = self.words[pattern] <= words.left[np.minimum(first, words.n - 1)]
        return first[ok], pattern[ok]


def _merge(old: list[dict], new: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for a, b in sorted([(x["first"], x["end"]) for x in old or []] + new):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"first": a, "end": b} for a, b in out]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every row of ``docs`` with its columns and ``_n_words``, ``_hits``, ``_items``.

    ``_hits`` holds the word ranges (first, end) inside any occurrence of a run of ``window`` words
    of a test item (a shorter item is one run), merged where they touch; ``_items`` the item_ids, as
    strings, with such an occurrence.  Null or wordless texts and items match nothing; items without
    an id mark words but are not listed; an item_id on several rows is one item.  Repeated rows are
    searched each on their own.  Empty tables give no rows or no hits.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    base = docs.withColumns({"_n_words": F.lit(0).cast("long"), "_hits": F.array().cast("array<struct<first:long,end:long>>"), "_items": F.array().cast("array<string>")})
    schema, names = base.schema, base.columns
    for b in range(max(1, blocks)):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, blocks))) == b)
        shared = spark.sparkContext.broadcast(Matcher([tuple(r) for r in part.collect()], window))
        base = base.mapInArrow(_searcher(shared, names), T.StructType(schema.fields))
    return base


def _searcher(shared, names):
    def run(batches):
        matcher = shared.value
        for rows, texts in slices(batches):
            words = Words(texts, ALNUM_LOWER)
            first, pattern = matcher.hits(words)
            doc = words.doc[first]
            spans, items = defaultdict(list), defaultdict(set)
            for d, a, p in zip(doc.tolist(), (first - words.first[doc]).tolist(), pattern.tolist()):
                spans[d].append((a, a + int(matcher.words[p])))
                items[d].update(matcher.owners[p])
            hits, owned = rows.column("_hits").to_pylist(), rows.column("_items").to_pylist()
            for d in spans:
                hits[d] = _merge(hits[d], spans[d])
                owned[d] = sorted(set(owned[d]) | items[d])
            new = {"_n_words": pa.array(words.counts, pa.int64()), "_hits": pa.array(hits, rows.schema.field("_hits").type), "_items": pa.array(owned, rows.schema.field("_items").type)}
            yield pa.RecordBatch.from_arrays([new.get(n, rows.column(n)) for n in names], schema=rows.schema)

    return run


def digest(found: DataFrame) -> DataFrame:
    """Counts and the digest of the item list per document."""
    n_hit = F.aggregate("_hits", F.lit(0).cast("long"), lambda a, h: a + h["end"] - h["first"])
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def clean_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) without any benchmark window."""
    return contamination(docs, benchmark).where(F.size("_hits") == 0).select(*docs.columns)

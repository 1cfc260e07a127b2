"""Token counts of fields or sections from one encoding of the whole document.

A document is encoded once.  Byte-level tokens partition its bytes, so token spans are running sums
of token lengths; sections, given in characters, become byte intervals, and an interval join of
sections with spans (binary search over sorted starts) attributes tokens.  A token that crosses a
boundary is allocated by an explicit rule:

* ``start``: to the section that holds its first byte,
* ``end``: to the section that holds its last byte,
* ``split``: to each section in proportion to its bytes.

With sections that partition the text every rule adds up to the document's token count.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidebar.llm.textbatch import slices

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before this vocabulary's merges
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("start", "end", "split")


class Tokens:
    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def edges(self, text: str) -> np.ndarray:
        """Byte positions of token boundaries, from 0 to the length of the text."""
        ids = self.encoding.encode_ordinary(text)
        return np.concatenate([[0], np.cumsum(self.lengths[ids])]).astype(np.int64) if ids else np.zeros(1, np.int64)


def allocate(edges: np.ndarray, start: np.ndarray, end: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens allocated to each byte interval, and how many of the tokens it touches cross its bounds."""
    first, last = edges[:-1], edges[1:] - 1
    end = np.maximum(start, end)
    touched = np.maximum(0, np.searchsorted(first, end, "left") - np.searchsorted(last, start, "left")) * (end > start)
    inside = np.maximum(0, np.searchsorted(last, end, "left") - np.searchsorted(first, start, "left")) * (end > start)
    if rule == "split":
        sizes = np.append(edges[1:] - edges[:-1], 1)

        def upto(x):
            x = np.clip(x, 0, edges[-1])
            k = np.searchsorted(edges, x, "right") - 1
            return k + (x - edges[k]) / sizes[k]

        return upto(end) - upto(start), touched - inside
    places = first if rule == "start" else last
    return (np.searchsorted(places, end, "left") - np.searchsorted(places, start, "left")).astype(float), touched - inside


def line_bounds(data: bytes) -> np.ndarray:
    """Byte bounds of the lines, each with its line end."""
    cuts = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return np.unique(np.concatenate([[0], cuts, [len(data)]])) if data else np.array([0, 0])


def char_starts(data: bytes) -> np.ndarray:
    """Byte position of every character, and the length at the end."""
    raw = np.frombuffer(data, np.uint8)
    return np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(data))


def count_tokens(docs: DataFrame, sections: DataFrame | None = None, rule: str = "start", ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """doc_id, section, first, end (characters), n_tokens, n_crossing, doc_tokens: one row per section.

    ``sections`` has doc_id, section, first, end in characters (end not included); they may overlap,
    leave gaps or reach past the text, where they are cut.  Without it the sections are the lines,
    numbered from 0.  Null texts count as empty and have one empty line.  Rows of ``docs`` that share
    a doc_id are counted each on its own; sections of unknown documents and with null bounds give no
    rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if sections is not None:
        parts = sections.where("first is not null and end is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(F.col("section").cast("string").alias("section"), F.col("first").cast("long").alias("first"), F.col("end").cast("long").alias("end")).alias("s"))
        rows = rows.join(parts.groupBy("doc_id").agg(F.array_sort(F.collect_list("s")).alias("parts")), "doc_id")

    given = sections is not None

    def run(batches):
        tokens = Tokens(ranks, pattern)
        for batch, texts in slices(batches):
            ids = batch.column("doc_id").to_pylist()
            asked = batch.column("parts").to_pylist() if given else None
            out = {k: [] for k in ("doc_id", "section", "first", "end", "n_tokens", "n_crossing", "doc_tokens")}
            at = []
            for k, data in enumerate(texts):
                edges = tokens.edges(data.decode())
                if asked is None:
                    bounds = line_bounds(data)
                    a, b = bounds[:-1], bounds[1:]
                    if len(data) == len(data.decode()):
                        first, end = a, b
                    else:
                        raw = np.frombuffer(data, np.uint8)
                        before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                        first, end = before[a], before[b]
                    names = np.arange(len(a))
                else:
                    starts = char_starts(data)
                    first, end = (np.clip([p[c] for p in asked[k]], 0, len(starts) - 1) for c in ("first", "end"))
                    end = np.maximum(first, end)
                    a, b, names = starts[first], starts[end], [p["section"] for p in asked[k]]
                n, crossing = allocate(edges, a, b, rule)
                at.append(len(a))
                for c, v in (("section", names), ("first", first), ("end", end), ("n_tokens", n), ("n_crossing", crossing), ("doc_tokens", np.full(len(a), len(edges) - 1))):
                    out[c].append(v)
            where = np.repeat(np.arange(len(ids)), at)
            names = pa.array(np.concatenate(out["section"]).astype(str).tolist() if asked is None else [x for v in out["section"] for x in v], pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()).take(pa.array(where)), names, *(pa.array(np.concatenate(out[c]), t) for c, t in (("first", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.float64()), ("n_crossing", pa.int64()), ("doc_tokens", pa.int64())))],
                ["doc_id", "section", "first", "end", "n_tokens", "n_crossing", "doc_tokens"],
            )

    return rows.mapInArrow(run, "doc_id long, section string, first long, end long, n_tokens double, n_crossing long, doc_tokens long")

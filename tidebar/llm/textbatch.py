"""Arrow batches of texts as byte buffers and word arrays.

Texts are handled as UTF-8 bytes in slices of a few MB, so that the arrays of one task stay small
whatever the number of rows in a batch.  A single longer text forms a slice of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 4 << 20  # bytes of text worked on at once
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
STEP, BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
# letters, digits and non-ASCII stay (A-Z lowered); every other byte becomes a space
ALNUM_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (splitmix finaliser)."""
    x = x + STEP
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


LETTERS = mix(np.arange(1, 257, dtype=np.uint64))  # one number per byte


def give_back() -> None:
    """Freed memory goes back to the system: a worker outlives its task, and what it holds counts for the next stage.

    Without glibc nothing happens.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is the empty text."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def slices(batches, text: str = "text", limit: int = SLICE) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut batches into runs of rows with about ``limit`` bytes of text; after the last one freed memory is given back."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        column = batch.column(text).cast(pa.binary())
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(column):
            done = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(at, to - at), texts_of(column.slice(at, to - at))
            at = to
        del batch, column
    give_back()


def single_rows(batches) -> Iterator[dict]:
    """Rows one by one, for rows that are large; after the last one freed memory is given back."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]
        del batch
    give_back()


class Words:
    """The words of some texts: byte buffer, word starts and ends, word counts and offsets per text."""

    def __init__(self, texts: list[bytes], table: bytes | None = None):
        lines = [b" ".join((t.translate(table) if table else t).split()) for t in texts]
        self.lines = lines
        self.buf = np.frombuffer(b" ".join(lines) + b" ", np.uint8)
        self.counts = np.array([(x.count(b" ") + 1) if x else 0 for x in lines], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        gaps = np.flatnonzero(self.buf == 32)
        starts = np.concatenate([[0], gaps[:-1] + 1]) if len(gaps) else np.zeros(0, np.int64)
        full = gaps > starts  # an empty text leaves an empty gap
        self.starts, self.ends = starts[full], gaps[full]
        self._hash = None

    @property
    def n(self) -> int:
        return len(self.starts)

    @property
    def doc(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    @property
    def left(self) -> np.ndarray:
        """Words from this one to the end of its text."""
        return np.repeat(self.first[1:], self.counts) - np.arange(self.n)

    @property
    def hashes(self) -> np.ndarray:
        if self._hash is None:
            self._hash = word_hashes(self.buf, self.starts, self.ends)
        return self._hash

    def word(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.ends[i]].tobytes()

    def span(self, i: int, j: int) -> bytes:
        """Words i to j-1 joined by single spaces."""
        return self.buf[self.starts[i] : self.ends[j - 1]].tobytes() if j > i else b""


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, part: int = 1 << 18) -> np.ndarray:
    """A 64-bit fingerprint of each byte span; about ``part`` bytes are worked on at once."""
    out = np.zeros(len(starts), np.uint64)
    lens = (ends - starts).astype(np.int64)
    upto = np.cumsum(lens)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + part, "right")))
        n = lens[a:b]
        edge = np.cumsum(n) - n
        inside = np.arange(int(n.sum())) - np.repeat(edge, n)
        parts = LETTERS[buf[inside + np.repeat(starts[a:b], n)]]
        parts *= powers(BASE, int(n.max()))[inside]
        out[a:b] = mix(np.add.reduceat(parts, edge))
        a = b
    return out


def ngram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Fingerprint of the k values from each position on (the last k-1 positions are meaningless)."""
    total, size, out, done = hashes * np.uint64(1), 1, None, 0
    factor = int(BASE)
    while True:
        if k & size:
            if out is None:
                out = total.copy()
            elif len(out) > done:
                out[: len(out) - done] += total[done:] * np.uint64(pow(factor, done, 1 << 64))
            done += size
        size *= 2
        if size > k:
            return mix(out)
        half, grown = size // 2, total.copy()
        if len(total) > half:
            grown[:-half] += total[half:] * np.uint64(pow(factor, half, 1 << 64))
        total = grown

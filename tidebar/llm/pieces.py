"""Encoding into vocabulary pieces by n-best search, and decoding.

A text is a lattice of pieces; the worth of a segmentation is the sum of its pieces' log
probabilities.  A forward Viterbi pass gives the best worth of every prefix.  These values are exact
heuristics for a backward A* search from the end, which therefore yields segmentations in order of
worth.  No piece spans a line end, and pieces hold a space mark only in front, so the lattice falls
into units (a word with the spaces before it); the search of a whole text is the search over its
units' n-best lists.  A unit's best and second-best worth come from the forward pass alone, so the
A* search runs only for the few units that the n best segmentations of the text can differ in.

Vocabularies are files of public tokenizers.  Piece probabilities follow their rank in the
vocabulary (1 / (rank + 10), normalised); bytes of characters outside it cost ten more than the
rarest piece.  Worths are whole numbers of millionths, so sums are exact and equal worths compare
equal in whatever order they were added.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import math
import operator
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidebar.llm.textbatch import slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NBEST = 4
UNIT = 1_000_000  # worths are counted in 1 / UNIT nats
MARK = "▁"
KEPT_UNITS = 100_000  # units of a generation; a worker remembers two, and units in use pass from the older one to the newer
KEPT_LONG = 20_000  # longer units that it remembers, and units whose n-best list it does
LEARN = 24  # longest unit that is searched together with others of its length
NONE = -(1 << 30)  # no path
_IDS, _WORTH, _LOSS = map(operator.itemgetter, range(3))
_UNITS = re.compile(" *[^ ]+| +")
_FACTOR, _SLOTS = np.uint64(0x9E3779B97F4A7C15), 20
_SPREAD = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9)


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ranks, self.byte_id, self.surface = {}, {}, {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.surface[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                ranks[piece] = (i, -sp.get_score(i))
                self.surface[i] = piece.replace(MARK, " ").encode()
        total = math.log(sum(1 / (r + 10) for _, r in ranks.values()))
        # keys hold plain spaces; a mark that occurs in a text is not a piece and becomes bytes
        self.pieces = {p.replace(MARK, " "): (i, round((-math.log(r + 10) - total) * UNIT)) for p, (i, r) in ranks.items()}
        self.longest = max(map(len, self.pieces))
        self.byte_worth = min(w for _, w in self.pieces.values()) - 10 * UNIT
        if len(self.byte_id) != 256 or any("\n" in p or " " in p.lstrip(" ") for p in self.pieces):
            raise ValueError("the vocabulary needs all byte pieces and spaces only in front")

        self._tables()

    def _tables(self):
        """Hash tables from the fingerprint of a piece, or of a piece's beginning, to its worth (NONE: no piece) and id."""
        found = {}
        for p, (i, w) in self.pieces.items():
            key = 0
            for c in p:
                key = (key * int(_FACTOR) + ord(c) + 1) % (1 << 64)
                found.setdefault(key, (0, NONE))
            found[key] = i, w
        keys = np.array(list(found), np.uint64)
        ids, worths = (np.array(x, np.int64) for x in zip(*found.values()))
        self.levels = []
        while len(keys):
            slot = (keys * _SPREAD[len(self.levels) % 2] >> np.uint64(64 - _SLOTS)).astype(np.int64)
            _, at = np.unique(slot, return_index=True)  # the others go one level down
            table = np.zeros(1 << _SLOTS, np.uint64), np.zeros(1 << _SLOTS, np.int32), np.zeros(1 << _SLOTS, np.int32)
            for column, values in zip(table, (keys, worths, ids)):
                column[slot[at]] = values[at]
            self.levels.append(table)
            left = np.ones(len(keys), bool)
            left[at] = False
            keys, ids, worths = keys[left], ids[left], worths[left]

    def lookup(self, keys: np.ndarray, level: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Worth (NONE: no piece) and id of each fingerprint, and whether a piece begins like that."""
        held, worths, numbers = self.levels[level]
        slot = (keys * _SPREAD[level % 2] >> np.uint64(64 - _SLOTS)).astype(np.int64)
        there = held[slot]
        ok = there == keys
        worth, ids = np.where(ok, worths[slot], NONE), np.where(ok, numbers[slot], 0)
        if level + 1 < len(self.levels):
            down = np.flatnonzero(~ok & (there != 0))  # only a taken slot sends keys down
            if len(down):
                worth[down], ids[down], ok[down] = self.lookup(keys[down], level + 1)
        return worth, ids, ok

    def best_of(self, units: list[str]) -> list[tuple[bytes, int, float]]:
        """``best`` of many units of one length at once: the same forward pass, column by column."""
        m, n = len(units), len(units[0])
        codes = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).reshape(m, n).T.astype(np.uint64, order="C") + np.uint64(1)
        worth = np.full((n + 1, m), NONE, np.int64)
        worth[0] = 0
        second = np.full((n + 1, m), NONE, np.int64)
        via, piece = np.zeros((n + 1, m), np.int32), np.zeros((n + 1, m), np.int32)
        plain = np.ones(m, bool)
        for j in range(n):
            rows, key = np.arange(m), np.zeros(m, np.uint64)
            for i in range(j + 1, min(n, j + self.longest) + 1):
                key = key * _FACTOR + codes[i - 1][rows]
                w, ids, begun = self.lookup(key)
                hit = w != NONE
                if i == j + 1:
                    plain &= hit
                r = rows[hit]
                w, old = w[hit] + worth[j][r], worth[i][r]
                better = w > old
                second[i][r] = np.maximum(second[i][r], np.where(better, old, w))
                worth[i][r] = np.maximum(old, w)
                up = r[better]
                via[i][up], piece[i][up] = j, ids[hit][better]
                rows, key = rows[begun], key[begun]
                if not len(rows):
                    break
        loss, at, rows = np.full(m, np.inf), np.full(m, n), np.arange(m)
        back = np.full((n, m), -1, np.int32)
        for k in range(n):
            on = at > 0
            a = np.where(on, at, 1)
            other = second[a, rows]
            loss = np.where(on & (other != NONE), np.minimum(loss, worth[a, rows] - other), loss)
            back[n - 1 - k] = np.where(on, piece[a, rows], -1)
            at = np.where(on, via[a, rows], 0)
        used = (back >= 0).sum(0)
        flat, out = np.ascontiguousarray(back.T), []
        for r, (k, total, least, fine) in enumerate(zip(used.tolist(), worth[n].tolist(), loss.tolist(), plain.tolist())):
            out.append((flat[r, n - k :].tobytes(), total, least) if fine else self.best(units[r]))
        return out

    def edges(self, unit: str) -> list[list[tuple[int, tuple[int, ...], int]]]:
        """Per end position the pieces (start, ids, worth) that end there."""
        get, out = self.pieces.get, [[]]
        for i in range(1, len(unit) + 1):
            here = [(j, (p[0],), p[1]) for j in range(max(0, i - self.longest), i) if (p := get(unit[j:i]))]
            if not here or here[-1][0] != i - 1:
                raw = unit[i - 1].encode()
                here.append((i - 1, tuple(self.byte_id[b] for b in raw), self.byte_worth * len(raw)))
            out.append(here)
        return out

    def forward(self, edges) -> tuple[list[int], list[tuple], list[float]]:
        """Best worth of every prefix, the piece it ends with, and what the next best piece there loses."""
        worth, last, loss = [0], [()], [math.inf]
        for here in edges[1:]:
            best, second, via = -math.inf, -math.inf, None
            for e in here:
                w = worth[e[0]] + e[2]
                if w > best:
                    best, second, via = w, best, e
                elif w > second:
                    second = w
            worth.append(best)
            last.append(via)
            loss.append(best - second)
        return worth, last, loss

    def best(self, unit: str) -> tuple[bytes, int, float]:
        """Ids (16 or 32 bit), worth, and the loss of the second-best segmentation."""
        worth, last, loss = self.forward(self.edges(unit))
        at, ids, least = len(unit), [], math.inf
        while at:
            least = min(least, loss[at])
            at, piece = last[at][0], last[at][1]
            ids.append(piece)
        return np.array([i for p in reversed(ids) for i in p], np.int32).tobytes(), worth[-1], least

    def nbest(self, unit: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """The n best segmentations (worth, ids) by backward A* with the forward worths as heuristics.

        Among equal estimates the node nearest to the start goes first, so ties don't widen the search.
        """
        edges = self.edges(unit)
        worth = self.forward(edges)[0]
        heap, out, serial = [(-worth[-1], len(unit), 0, 0, None)], [], 0
        while heap and len(out) < n:
            estimate, at, _, behind, tail = heapq.heappop(heap)
            if at == 0:
                ids = []
                while tail:
                    ids.extend(tail[0])
                    tail = tail[1]
                out.append((-estimate, tuple(ids)))
                continue
            for start, piece, w in edges[at]:
                serial += 1
                heapq.heappush(heap, (-(worth[start] + w + behind), start, serial, w + behind, (piece, tail)))
        return out


class Encoder:
    def __init__(self, path: str, nbest: int):
        self.vocab, self.n = Vocabulary(path), nbest
        self.known: dict[str, tuple[bytes, int, float]] = {}
        self.older: dict[str, tuple[bytes, int, float]] = {}
        self.long: dict[str, tuple[bytes, int, float]] = {}  # units that learn() leaves out
        self.lists: dict[str, list[tuple[int, tuple[int, ...]]]] = {}  # n-best lists of short units
        self.newline = (np.array([self.vocab.byte_id[10]], np.int32).tobytes(), self.vocab.byte_worth, math.inf)

    def unit(self, unit: str) -> tuple[bytes, int, float]:
        found = self.known.get(unit) or self.long.get(unit)
        if found is None:
            found = self.vocab.best(unit)
            if len(unit) <= 32:
                if len(self.long) >= KEPT_LONG:
                    self.long.clear()
                self.long[unit] = found
        return found

    def nbest(self, unit: str) -> list[tuple[int, tuple[int, ...]]]:
        found = self.lists.get(unit)
        if found is None:
            found = self.vocab.nbest(unit, self.n)
            if len(unit) <= LEARN:
                if len(self.lists) >= KEPT_LONG:
                    self.lists.clear()
                self.lists[unit] = found
        return found

    def learn(self, lists: list[list[str]]) -> None:
        """Search the units of some texts that are not known yet, many at a time."""
        if len(self.known) >= KEPT_UNITS:
            self.older, self.known = self.known, {}
        by_length: dict[int, list[str]] = {}
        for u in set().union(*lists).difference(self.known):
            if len(u) <= LEARN and u != "\n":
                if found := self.older.get(u):
                    self.known[u] = found
                else:
                    by_length.setdefault(len(u), []).append(u)
        for same in by_length.values():
            for a in range(0, len(same), 20000):
                some = same[a : a + 20000]
                self.known.update(zip(some, self.vocab.best_of(some)))

    def units(self, text: str) -> list[str]:
        """Units of a text with its leading space mark; a line end is a unit of its own."""
        out, first = [], True
        for line in (" " + text).split("\n"):
            if not first:
                out.append("\n")
            first = False
            if "  " in line or line[-1:] == " ":
                out += _UNITS.findall(line)
            elif line:
                words = line.split(" ")
                if words[0]:
                    out.append(words[0])
                out += [" " + w for w in words[1:]]
        return out

    def encode(self, units: list[str]) -> tuple[int, bytes, list[tuple[int, list[tuple[int, int, tuple[int, ...]]]]]]:
        """Worth and ids of the best segmentation, and of the next best ones what they lose and change.

        A change (first, n, ids) puts other ids in the place of n ids of the best segmentation.
        """
        get, new, line_end = self.known.get, self.unit, self.newline
        found = list(map(get, units))
        if None in found:
            found = [f or (line_end if u == "\n" else new(u)) for f, u in zip(found, units)]
        ids = list(map(_IDS, found))
        out = []
        if self.n > 1 and found:
            loss = np.fromiter(map(_LOSS, found), np.float64, len(found))
            ways = [(0, ())]
            for k in np.sort(self._least(loss)).tolist():
                if loss[k] == math.inf:
                    continue
                lists = self.nbest(units[k])
                ways = heapq.nsmallest(self.n, [(a + lists[0][0] - w, (*path, (k, i))) for a, path in ways for w, i in lists], key=lambda x: x[0])
                ways[0] = (0, ())  # the best of every unit is no change
            for lost, path in ways[1:]:
                changes = []
                for k, other in path:
                    own = tuple(np.frombuffer(ids[k], np.int32).tolist())
                    if own != other:
                        changes.append((sum(map(len, ids[:k])) // 4, len(own), other))
                out.append((lost, changes))
        return sum(map(_WORTH, found)), b"".join(ids), out

    def _least(self, loss: np.ndarray) -> np.ndarray:
        """Positions of the n-1 smallest losses, earlier ones first among equals."""
        if len(loss) < self.n:
            return np.arange(len(loss))
        bound = np.partition(loss, self.n - 2)[self.n - 2]
        below = np.flatnonzero(loss < bound)
        return np.concatenate([below, np.flatnonzero(loss == bound)[: self.n - 1 - len(below)]])


@functools.lru_cache(maxsize=1)
def _encoder(model: str, nbest: int) -> Encoder:
    """One per Python worker: what a task learnt serves the worker's next tasks."""
    return Encoder(model, nbest)


ENCODED = "doc_id long, ids array<int>, n_pieces long, score double, alternatives array<struct<score:double,changes:array<struct<first:int,n:int,ids:array<int>>>>>"


def _encoded(batches, model: str, nbest: int):
    """The texts of some rows and what ``encode`` gives for them."""
    change = pa.struct([("first", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int32()))])
    kind = pa.list_(pa.struct([("score", pa.float64()), ("changes", pa.list_(change))]))
    encoder = _encoder(model, nbest)
    for rows, texts in slices(batches):
        units = [encoder.units(t.decode()) if t else [] for t in texts]
        encoder.learn(units)
        worth, ids, more = zip(*map(encoder.encode, units))
        size = np.array([len(i) // 4 for i in ids], np.int64)
        best = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))
        other = [[{"score": (w - lost) / UNIT, "changes": [dict(zip(("first", "n", "ids"), c)) for c in changes]} for lost, changes in m] for w, m in zip(worth, more)]
        yield texts, pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), best, pa.array(size), pa.array(np.array(worth) / UNIT, pa.float64()), pa.array(other, kind)],
            ["doc_id", "ids", "n_pieces", "score", "alternatives"],
        )


@functools.lru_cache(maxsize=1)
def _surfaces(model: str) -> list[bytes]:
    surface = Vocabulary(model).surface
    return [surface.get(i, b"") for i in range(max(surface) + 1)]


def _decoded(ids: pa.Array, table: list[bytes]) -> list[bytes]:
    """Text of each list of ids, without the leading space mark."""
    flat, at, texts = ids.flatten().to_numpy(zero_copy_only=False).tolist(), 0, []
    for n in np.diff(ids.offsets.to_numpy()).tolist():
        texts.append(b"".join([table[i] for i in flat[at : at + n]])[1:])
        at += n
    return texts


def encode(docs: DataFrame, model: str = MODEL, nbest: int = NBEST) -> DataFrame:
    """doc_id, ids, n_pieces, score, alternatives: one row per row of ``docs``.

    ``alternatives`` holds the next best segmentations, best first, fewer where the text has no more:
    the score, and ``changes`` (first, n, ids) that put other ids in the place of n of the best ids.
    Ties prefer longer pieces at the end of a unit, then earlier units.  Null and empty texts have no
    pieces and score 0.  Very long texts and words are searched whole.  An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: (out for _, out in _encoded(batches, model, nbest)), ENCODED)


def round_trip(docs: DataFrame, model: str = MODEL, nbest: int = NBEST) -> DataFrame:
    """As ``encode``, with the ids of the best segmentation decoded again for every row.

    ``text_sha256`` is that of the decoded text, ``same`` says that it is the text byte for byte
    (null: the empty text).
    """

    def run(batches):
        table = _surfaces(model)
        for texts, out in _encoded(batches, model, nbest):
            back = _decoded(out.column("ids"), table)
            more = [pa.array([hashlib.sha256(t).hexdigest() for t in back], pa.string()), pa.array([a == b for a, b in zip(back, texts)], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*out.columns, *more], [*out.schema.names, "text_sha256", "same"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, ENCODED + ", text_sha256 string, same boolean")


def changed(ids: list[int], changes) -> list[int]:
    """The ids of an alternative segmentation."""
    out = list(ids)
    for first, n, other in sorted(changes, reverse=True):
        out[first : first + n] = other
    return out


def decode(encoded: DataFrame, model: str = MODEL, ids: str = "ids") -> DataFrame:
    """doc_id and text from piece ids, the exact inverse of ``encode`` (null: the empty text)."""

    def run(batches):
        table = _surfaces(model)
        for rows in batches:
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(_decoded(rows.column(1), table), pa.binary()).cast(pa.string())], ["doc_id", "text"])

    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(run, "doc_id long, text string")

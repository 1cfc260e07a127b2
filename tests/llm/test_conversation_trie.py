import hashlib
import random
import zlib

import pytest

from tidebar.llm.conversation_trie import HEAD, conversation_trie, middles

ROWS = "conv_id long, turn long, role string, text string, edge string, ids int"
COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """The same trie from whole tuples."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in convs.items()}
    paths = {}
    for c, turns in own.items():
        base, h = c - int(c % 100 if c >= 0 else -(-c % 100)), zlib.crc32(str(c).encode()) % (HEAD + 1)
        paths[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    below = {}
    for p in members:
        if p:
            below.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        kids = below.get(p, [])
        leaves[p] = sum(leaves[k] for k in kids) or 1
        saved[p] = sum(saved[k] for k in kids) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(paths[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(below.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, shard=100_000):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS)
    out = conversation_trie(df, shard)
    assert out.columns == COLS
    return sorted(map(tuple, out.collect()), key=str)


def test_middles():
    assert list(middles(7)) == [3, 1, 5, 0, 2, 4, 6] and list(middles(0)) == []


@pytest.mark.parametrize("shard", [100_000, 25])
def test_like_plain(spark, shard):
    """Copies, shared beginnings and tails, and shards small enough that most nodes lie on a border."""
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 260), 700, 1100, 1101, -3, -250]:
        kind = rng.random()
        n = 0 if kind < 0.05 else rng.randint(1, 9)
        start = rng.randint(0, 3)
        for t in range(n):
            word = f"turn {start} {t}" if kind < 0.5 else f"turn {rng.randint(0, 2)}"
            rows.append((c, t, "user" if t % 2 else "assistant", word))
    rng.shuffle(rows)
    assert run(spark, rows, shard) == plain(rows)


def test_group_of_copies(spark):
    """A third of all conversations are equal and their members fill several pieces."""
    rows = [(c, t, "user", f"same {t}") for c in range(100, 100 * 9000, 300) for t in range(3)]
    rows += [(c, t, "user", f"own {c} {t}") for c in range(101, 100 * 600, 300) for t in range(2)]
    assert run(spark, rows, 200) == plain(rows)


def test_nulls_empty_long_and_repeats(spark):
    rows = [(5, None, None, None), (5, 1, "user", ""), (5, 1, "user", ""), (6, 2, "user", "x" * 300_000), (6, None, "a", "é😀"), (7, 0, None, "a"), (107, 0, "", "a"), (None, 1, "user", "lost"), (100, None, None, None)]
    assert run(spark, rows) == plain(rows)
    assert run(spark, rows, 1) == plain(rows)


def test_only_turnless(spark):
    """Conversation 1 loses its only turn to an absent first conversation."""
    c = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 0)
    got = run(spark, [(c, 0, "user", "gone")])
    assert got == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_empty(spark):
    assert run(spark, []) == []


def test_long_conversation(spark):
    rows = [(0, t, "user", f"t{t}") for t in range(3000)] + [(100, t, "user", f"t{t}") for t in range(2500)]
    assert run(spark, rows, 500) == plain(rows)


def test_query(same_as_oracle):
    assert len(same_as_oracle("op13_conversation_trie", "/root/testdata/sf0.01")) > 300

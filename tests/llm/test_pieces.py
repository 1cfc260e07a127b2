import hashlib
import itertools

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

import corpus_pipeline
from tidebar.llm import pieces
from tidebar.llm.pieces import MODEL, Encoder, Vocabulary, _decoded, _encoded, _surfaces, changed, decode, encode
from tidebar.llm.queries import QUERIES


@pytest.fixture(scope="module")
def vocab():
    return Vocabulary(MODEL)


def segmentations(encoder, text):
    units = encoder.units(text) if text else []
    encoder.learn([units])
    worth, ids, more = encoder.encode(units)
    ids = np.frombuffer(ids, np.int32).tolist()
    return [(worth, ids), *((worth - lost, changed(ids, changes)) for lost, changes in more)]


def every(vocab, text):
    """Worth of every segmentation of a text, by plain recursion over the whole lattice."""
    edges = vocab.edges(text)

    def walk(at):
        if at == 0:
            return [(0, ())]
        return [(w + x[2], ids + x[1]) for x in edges[at] for w, ids in walk(x[0])]

    return sorted(walk(len(text)), key=lambda x: -x[0])


@pytest.mark.parametrize("text", ["thin man", "a", "the\nend", "  two  b ", "é▁x", "\n", "aaaa aaaa", "日 本", "\x00 \t"])
def test_nbest_is_exact(vocab, text):
    got = segmentations(Encoder(MODEL, 5), text)
    want = every(vocab, " " + text)
    assert [w for w, _ in got] == [w for w, _ in want[:5]]
    every_ids = {ids: w for w, ids in want}
    assert len({tuple(i) for _, i in got}) == len(got)
    for w, ids in got:
        assert every_ids[tuple(ids)] == w
        assert b"".join(vocab.surface[i] for i in ids)[1:].decode() == text


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_round_trip(text):
    found = segmentations(test_round_trip.encoder, text)
    for _, ids in found:
        assert b"".join(test_round_trip.encoder.vocab.surface[i] for i in ids)[1:].decode() == text


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abe nt日é", min_size=5, max_size=5), min_size=1, max_size=8))
def test_many_at_once(units):
    vocab = test_round_trip.encoder.vocab
    assert vocab.best_of(units) == [vocab.best(u) for u in units]


test_round_trip.encoder = Encoder(MODEL, 3)


def test_rows(spark, docs_of):
    rows = [(1, "Some text\nwith  lines "), (2, None), (3, ""), (4, "x" * 20000), (5, " ".join(map(str, range(9000)))), (None, "a"), (1, "Some text\nwith  lines ")]
    got = encode(docs_of(rows))
    assert sorted([(r.doc_id, r.text) for r in decode(got).collect()], key=repr) == sorted([(i, t or "") for i, t in rows], key=repr)
    for r in got.collect():
        assert r.n_pieces == len(r.ids) and (r.n_pieces > 0) == (r.score < 0)
        scores = [r.score, *(a.score for a in r.alternatives)]
        assert all(a >= b - 1e-9 for a, b in itertools.pairwise(scores))
    assert encode(docs_of([])).count() == 0
    assert decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first().text == ""


def test_query_and_stage_decode(spark, docs_of, sf_of):
    odd = [None, "", " ", "  a  ", "\n\n", "a\r\nb\t", "▁é▁", "\x00\x01\x7f", "e\u0301 \u200d👩‍👩‍👧 \ufeff", "x" * 300000, "日本語" * 20000, " ".join(f"w{i}" for i in range(60000))]
    rows = [(i, t) for i, t in enumerate(odd)] + [(None, "a"), (3, "a again")]
    sf = sf_of(rows)
    want = sorted([(i, hashlib.sha256((t or "").encode()).hexdigest(), True) for i, t in rows], key=repr)
    for out in (QUERIES["op4_sentencepiece_nbest"](spark, sf), corpus_pipeline.encode_pieces(spark, docs_of(rows), sf)):
        assert sorted([(r.doc_id, r.text_sha256, r.same) for r in out.collect()], key=repr) == want


def test_lost_pieces_show():
    encoder = Encoder(MODEL, 1)
    ids = np.frombuffer(encoder.encode(encoder.units("some text"))[1], np.int32)
    back = _decoded(pa.array([ids.tolist(), ids[:-1].tolist()], pa.list_(pa.int32())), _surfaces(MODEL))
    assert back[0] == b"some text" != back[1]


def test_learnt_units_serve_the_next_task(monkeypatch):
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["zebra crossing\nat noon"]})
    first = [out for _, out in _encoded([batch], MODEL, 3)]

    def again(*args):
        raise AssertionError("searched again")

    for name in ("__init__", "best", "best_of", "nbest"):
        monkeypatch.setattr(Vocabulary, name, again)
    assert [out for _, out in _encoded([batch], MODEL, 3)] == first


def test_a_long_unit_does_not_forget_the_others(monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_UNITS", 2)
    encoder = Encoder(MODEL, 3)
    encoder.learn([["The", " zebra", " crossing"]])
    assert encoder.unit("x" * 30) == encoder.vocab.best("x" * 30) and {"The", " zebra", " crossing"} <= set(encoder.known)
    kept = encoder.known[" zebra"]
    encoder.learn([[" zebra", " noon"]])  # a new generation
    assert encoder.known[" zebra"] is kept and set(encoder.known) == {" zebra", " noon"}


def test_remembered_units_are_bounded(monkeypatch):
    encoder = pieces.Encoder(pieces.MODEL, 4)
    monkeypatch.setattr(encoder.vocab, "best_of", lambda units: [(b"", 0, 0.0)] * len(units))
    for k in range(8):
        encoder.learn([[f" {k}x{i}" for i in range(50_000)]])
    assert len(encoder.known) + len(encoder.older) <= 300_000

import pytest

from tidebar.llm.exact_dedup import PRIMES, chunk_values, exact_dedup, keep_last


def test_values_combine():
    a, b = b"some text \x00", b"and the rest" * 50
    va, vb, whole = chunk_values(a), chunk_values(b), chunk_values(a + b)
    for k, p in ((0, PRIMES[0]), (2, PRIMES[1])):
        assert (va[k] * vb[k + 1] + vb[k]) % p == whole[k]
        assert va[k + 1] * vb[k + 1] % p == whole[k + 1]


def brute(rows):
    rows = list(dict.fromkeys((i, t or "") for i, t in rows))
    out = []
    for i, t in rows:
        same = [j for j, u in rows if u == t]
        keep = max((j for j in same if j is not None), default=None)
        out.append((i, keep, len(same), i == keep))
    return sorted(out, key=repr)


ROWS = [(1, "a"), (2, None), (3, ""), (4, "a"), (5, "b" * 5000), (6, "b" * 5000), (7, "b" * 4999 + "c"), (7, "b" * 4999 + "c"), (7, "other"), (None, "a"), (None, "z"), (8, "é" * 700)]


@pytest.mark.parametrize("weak", [False, True])
def test_classes(docs_of, weak):
    # with tiny primes all texts of a length collide, and only the comparison tells them apart
    got = exact_dedup(docs_of(ROWS), chunk=64, compare=100, primes=(3, 2) if weak else PRIMES)
    assert sorted([tuple(r)[:4] for r in got.collect()], key=repr) == brute(ROWS)


def test_kept_rows(docs_of):
    got = keep_last(docs_of(ROWS))
    assert got.columns == docs_of(ROWS).columns
    assert sorted([(r.doc_id, (r.text or "")[:5]) for r in got.collect()], key=repr) == sorted([(3, ""), (4, "a"), (6, "bbbbb"), (7, "bbbbb"), (7, "other"), (None, "z"), (8, "ééééé")], key=repr)


def test_empty(docs_of):
    assert exact_dedup(docs_of([])).count() == 0


def test_oracle(same_as_oracle):
    assert same_as_oracle("op8_exact_dedup")

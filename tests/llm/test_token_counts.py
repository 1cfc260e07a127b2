import pytest

from tidebar.llm.token_counts import PATTERN, RANKS, Tokens, count_tokens

ROWS = [(1, "First line\nsecond, línea más larga\n\nlast"), (2, None), (3, ""), (4, "word " * 4000), (5, "no end\n"), (None, "x y"), (7, "日本語 text"), (7, "日本語 text")]


def spans(text):
    return Tokens(RANKS, PATTERN).edges(text).tolist()


def brute(text, first, end, rule):
    edges, n, crossing = spans(text), 0.0, 0
    a, b = len(text[:first].encode()), len(text[:end].encode())
    for s, e in zip(edges, edges[1:]):
        over = max(0, min(e, b) - max(s, a))
        crossing += 0 < over < e - s
        n += {"start": a <= s < b, "end": a <= e - 1 < b, "split": over / (e - s)}[rule]
    return round(n, 6), crossing


@pytest.mark.parametrize("rule", ["start", "end", "split"])
def test_lines(docs_of, rule):
    got = [r for r in count_tokens(docs_of(ROWS), rule=rule).collect() if r.doc_id != 4]
    want = []
    for i, t in ROWS:
        if i == 4:
            continue
        lines, at = (t or "").splitlines(keepends=True) or [""], 0
        for k, line in enumerate(lines):
            want.append((i, str(k), at, at + len(line), *brute(t or "", at, at + len(line), rule), len(spans(t or "")) - 1))
            at += len(line)
    assert sorted([(r.doc_id, r.section, r.first, r.end, round(r.n_tokens, 6), r.n_crossing, r.doc_tokens) for r in got], key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("rule", ["start", "end", "split"])
def test_sections(spark, docs_of, rule):
    texts = {1: ROWS[0][1], 4: ROWS[3][1], 7: ROWS[6][1]}
    parts = [(1, "title", 0, 8), (1, "over", 3, 20), (1, "past", 30, 999), (1, "none", 5, 5), (4, "middle", 101, 15003), (7, "mid", 1, 5), (9, "lost", 0, 3), (1, "null", None, 4)]
    got = count_tokens(docs_of(ROWS), spark.createDataFrame(parts, "doc_id long, section string, first long, end long"), rule)
    want = []
    for i, name, a, b in parts:
        if i in texts and a is not None:
            t = texts[i]
            a, b = min(a, len(t)), min(b, len(t))
            want += [(i, name, a, b, *brute(t, a, b, rule))] * (2 if i == 7 else 1)
    assert sorted((r.doc_id, r.section, r.first, r.end, round(r.n_tokens, 6), r.n_crossing) for r in got.collect()) == sorted(want)


def test_rules_add_up(docs_of):
    for rule in ("start", "end", "split"):
        for r in count_tokens(docs_of(ROWS), rule=rule).groupBy("doc_id").agg({"n_tokens": "sum", "doc_tokens": "avg", "*": "count"}).collect():
            assert abs(r["sum(n_tokens)"] - r["avg(doc_tokens)"] * (2 if r.doc_id == 7 else 1)) < 1e-6


def test_edges(docs_of):
    assert count_tokens(docs_of([])).count() == 0
    with pytest.raises(ValueError):
        count_tokens(docs_of([]), rule="middle")

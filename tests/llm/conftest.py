import os

import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, hash string, n long"


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with extra columns whose names clash with internal ones."""

    def make(rows):
        return spark.createDataFrame([(i, t, None, "s", None, "x", 7) for i, t in rows], DOCS)

    return make


@pytest.fixture
def sf_of(tmp_path, docs_of):
    """A folder with a documents table."""

    def make(rows):
        docs_of(rows).select("doc_id", "text", "lang", "source", "n_chars").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return make


@pytest.fixture(scope="session")
def same_as_oracle(spark):
    """Compare a registered query with its DuckDB text."""
    import duckdb

    from tidebar.llm.queries import ORACLES, QUERIES

    def check(name, sf=SF):
        con = duckdb.connect()
        for t in os.listdir(sf):
            at = f"{sf}/{t}/*.parquet" if os.path.isdir(f"{sf}/{t}") else f"{sf}/{t}"
            con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{at}'")
        want = con.sql(ORACLES[name])
        got = QUERIES[name](spark, sf)
        cols = sorted(want.columns)
        assert sorted(got.columns) == cols
        norm = lambda r: tuple(tuple(x) if isinstance(x, list) else round(x, 6) if isinstance(x, float) else x for x in r)
        a = sorted(map(norm, got.select(cols).collect()), key=repr)
        b = sorted(map(norm, want.select(", ".join(cols)).fetchall()), key=repr)
        assert len(a) == len(b)
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        assert not bad, (len(bad), bad[:3])
        return a

    return check

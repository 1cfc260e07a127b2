import os

import pytest

from tidebar.session import WRITTEN, cut_lineage, drop_tables, scoped_tables


def test_tables_of_a_block_go(spark):
    before = cut_lineage(spark.range(3))
    kept = len(WRITTEN)
    with scoped_tables(spark):
        df = cut_lineage(cut_lineage(spark.range(5)).where("id > 1"))
        paths = WRITTEN[kept:]
        assert df.count() == 3 and len(paths) == 2 and all(map(os.path.exists, paths))
    assert len(WRITTEN) == kept and not any(map(os.path.exists, paths))
    assert before.count() == 3


def test_tables_go_after_an_error(spark):
    kept = len(WRITTEN)
    with pytest.raises(RuntimeError), scoped_tables(spark):
        cut_lineage(spark.range(2))
        path = WRITTEN[-1]
        raise RuntimeError
    assert not os.path.exists(path) and drop_tables(spark, kept) == 0

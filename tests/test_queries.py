"""Every registered query of the extraction operators against its SQL on the smallest tables."""

import os

import pytest

from tests.compare import oracle, rows
from weftline.plans import queries as plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", list(plans.FOUND))
def test_query(spark, name):
    query, sql = plans.FOUND[name]
    got = query(spark, SF).toPandas()
    if sql:
        want = oracle(sql, SF)
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as e

    out = e.entry(spark)
    assert {"page_id", "markdown", "content_source", "error_code", "message"} <= set(out.columns)
    assert out.filter("markdown IS NULL AND message IS NULL").count() == 0
    assert set(e.oracle_sql()) <= set(e.queries())

"""The driver's contract."""

import os

import pytest

import __spark_entry__ as entry


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 80
    assert all(callable(q) for q in queries.values()) and all(isinstance(s, str) for s in sql.values())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["schema_id", "doc_id", "reason"] and {r.reason for r in df.collect()} == {"schema_error", "stale_fk"}

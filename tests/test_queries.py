"""Every named query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, duck


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, sf, con, name):
    result = entry.queries()[name](spark, sf)
    text = result._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert result.count() > 0
    else:
        assert compare(result, con, sql) is None


@pytest.mark.parametrize("name", ["stream_dead_letters", "stream_skill_tracker", "stream_feedback_pairs"])
def test_stream_of_a_table_of_many_files(spark, sf, con, name, tmp_path):
    """Large tables are folders of files; their streams read all of them."""
    for table in ("documents", "events"):
        spark.read.parquet(f"{sf}/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    (tmp_path / "benchmark.parquet").symlink_to(f"{sf}/benchmark.parquet")
    result = entry.queries()[name](spark, str(tmp_path))
    assert compare(result, con, entry.oracle_sql()[name]) is None

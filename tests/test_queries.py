import pytest
from compare import DATA, check

import __spark_entry__ as entry
from foliant import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_sql(spark, name):
    check(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["k", "n"] and df.count() == 10
    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert DATA.endswith("sf0.001")


def test_leaf_pruning_and_pushdown(spark):
    e = queries._with(queries.engine_for(spark, DATA), "oj")
    plan = e.sql("SELECT o_orderkey FROM oj WHERE doc.customer.key = 7")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,doc:struct<customer:struct<key:bigint>>>" in plan
    assert "EqualTo(doc.customer.key,7)" in plan

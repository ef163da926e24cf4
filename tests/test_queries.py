import pytest

import oracle
from stratavox import queries as Q


@pytest.mark.parametrize("name", [n for n in Q.QUERIES if n in Q.ORACLE_SQL])
def test_against_sql(spark, small, name):
    got, want = oracle.both(spark, small, Q.QUERIES[name], Q.ORACLE_SQL[name])
    assert got == want


@pytest.mark.parametrize("name", [n for n in Q.QUERIES if n not in Q.ORACLE_SQL])
def test_rows(spark, small, name):
    assert Q.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 31
    assert set(e.oracle_sql()) <= set(e.queries())


def test_components_of_a_long_chain_and_of_nothing(spark):
    from stratavox.operators.components import connected_components

    n = 300
    chain = spark.range(n).selectExpr("id AS a", "id + 1 AS b").union(spark.createDataFrame([(1000, 1000), (2000, 2001), (None, 5)], "a long, b long"))
    got = {r["node"]: r["root"] for r in connected_components(chain).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {2000: 2000, 2001: 2000}
    assert connected_components(chain.limit(0)).count() == 0
    star = spark.range(1, 500).selectExpr("id AS a", "1000 AS b")
    assert {r["root"] for r in connected_components(star).collect()} == {1}

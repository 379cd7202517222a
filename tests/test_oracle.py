"""Every registered query against its SQL, and the contract of the entry module."""

import pytest
from conftest import SF
from oracle_check import compare, connect

from vigilspark.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    assert compare(spark, duck, SF, name, QUERIES[name], ORACLES[name]) is None


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize(
    "name", ["a01_entity_rollup", "w05_cumulative_risk", "w08_suppress", "a25_describe_by", "m09_pagerank"]
)
def test_independent_of_partitioning(spark, name):
    def rows(partitions):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        return sorted(map(repr, QUERIES[name](spark, SF).collect()))

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert rows("3") == rows("17")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)

"""Every registered query against its SQL on DuckDB."""

import pytest
from check_oracle import connection, difference

from __spark_entry__ import entry, oracle_sql, queries
from aircapture.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    assert name in oracle_sql()
    assert difference(queries()[name], oracle_sql()[name], spark, con, sf_dir) is None


def test_entry(spark):
    rows = entry(spark)
    assert rows.columns == ["operator", "doc_count"] and rows.count() > 0


@pytest.mark.parametrize("name", ["f7_data_for_device", "f14_device_packets", "w7_flow_lookup", "w7_flow_lookup_first"])
def test_lookups_find_something(spark, sf_dir, name):
    assert queries()[name](spark, sf_dir).count() > 0

import pytest

import __spark_entry__ as entry
from sieveline import queries as own

from oracle import assert_same

SF = "/root/testdata/sf0.001"
SQL = own.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    assert_same(spark, own.queries()[name], SQL[name], SF)


def test_queries_without_sql(spark):
    assert set(own.queries()) - set(SQL) == {"video_sizes"}
    s = own.video_sizes(spark, SF).first()
    assert 0 < s.compressed_size and s.space_savings == pytest.approx(1 - s.compression_ratio)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(r.witness_len >= r.ones for r in rows)
    assert set(entry.oracle_sql()) <= set(entry.queries())

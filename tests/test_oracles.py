"""A share of the registered queries against their SQL on the smallest tables."""

import pytest

from workload import catalog
from workload.compare import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.load()
SKIP_SLOW = ("pack_", "interprocedural", "apply_function", "field_taint", "file_level")
NAMES = [n for n in QUERIES if not n.startswith(SKIP_SLOW)] + ["pack_php_sql_injection", "pack_markup"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    ok, text = compare(spark, con, SF, name, QUERIES[name], ORACLES.get(name))
    assert ok, text


def test_every_query_but_findings_by_function_has_sql():
    assert set(QUERIES) <= set(ORACLES) | {"function_findings"}

"""Every registered query against its SQL on the same tables."""

import os

import pytest
from compare import differences, duck

import __spark_entry__ as driver
from sparkboard.plans.registry import registered

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(registered()))
def test_query_equals_sql(spark, con, name):
    query = registered()[name]
    assert query.sql, "no SQL to compare with"
    assert differences(query.build(spark, FOLDER), con, query.sql) == []


def test_driver_contract(spark):
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert driver.entry(spark).count() == 5


def test_every_operator_of_the_inventory_is_covered():
    wanted = {
        *(f"E{i}" for i in range(1, 14)), *(f"P{i}" for i in range(1, 5)),
        *(f"Q{i}" for i in range(11)), *(f"N{i}" for i in range(1, 7)),
        *(f"R{i}" for i in range(1, 8)), *(f"C{i}" for i in range(1, 16)),
        *(f"A{i}" for i in range(1, 4)), *(f"H{i}" for i in range(1, 8)), "L1",
    }
    covered = {c for q in registered().values() for c in q.covers.split()}
    assert wanted - covered == set()

"""Every registered query against its SQL on the smallest supplied tables."""

import os

import pytest

import __spark_entry__ as entry
from gradus import plans
from tools.check import compare, connect

BASE = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="no supplied tables")


@pytest.fixture(scope="module")
def duck():
    return connect(BASE)


plans.load_all()


@pytest.mark.parametrize("name", list(plans.ORACLES))
def test_query(spark, duck, name):
    text, ok = compare(spark, duck, BASE, name)
    assert ok, text


def test_every_query_has_sql():
    assert set(plans.QUERIES) == set(plans.ORACLES)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0

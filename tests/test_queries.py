"""Every registered query against its SQL check."""

import pytest
from compare import compare, connect

from tabscry.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    assert compare(spark, con, name, QUERIES[name], ORACLES.get(name), sf_dir) is None


def test_every_check_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() == 6

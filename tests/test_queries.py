"""Every query of the catalogue against its oracle."""

import os

import pytest

import __spark_entry__
from strataline.plans import catalog, file_queries  # noqa: F401  it registers its queries
from tests import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.SF_DIR), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    oracle.same(catalog.QUERIES[name](spark, oracle.SF_DIR), catalog.ORACLES[name])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 11
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

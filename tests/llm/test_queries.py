"""Queries that SQL can express, against their oracles; and that all are registered."""

import os

import pytest

import __spark_entry__
from strataline.llm import queries
from tests import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.SF_DIR), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    oracle.same(queries.QUERIES[name](spark, oracle.SF_DIR), queries.ORACLES[name])


def test_all_are_registered():
    names = list(__spark_entry__.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names

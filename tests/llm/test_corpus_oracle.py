"""The corpus queries that SQL can express, against DuckDB over the same tables."""

import os

import pytest
from oracle import compare, views

from tidewatch.llm.queries import oracle_sql, queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert compare(queries()[name](spark, SF_DIR), views(SF_DIR), oracle_sql()[name]) == ""

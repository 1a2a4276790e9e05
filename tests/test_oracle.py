import os

import pytest
from oracle import compare, views

from tidewatch.plans.queries import QUERIES, SQL

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return views(SF_DIR)


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_its_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF_DIR), con, SQL[name]) == ""


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    assert df.count() > 0 and len(df.columns) == len(set(df.columns))

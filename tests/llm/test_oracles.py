"""Every query of the subpackage with SQL gives the rows of its SQL on the smallest tables."""

import pytest

from sheafline.llm.queries import QUERIES, SQL
from tests.conftest import SMALL, rows_of


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, oracle, name):
    got, want = QUERIES[name](spark, SMALL).toPandas(), oracle(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, oracle, name):
    assert QUERIES[name](spark, SMALL).count() > 0

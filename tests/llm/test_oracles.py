"""The queries of the subpackage against their SQL on the smallest tables."""

import pytest

from corpusloom.llm import queries
from tests.test_queries import duck, rows  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, sf, duck, name):  # noqa: F811
    got, want = queries.QUERIES[name](spark, sf).toPandas(), duck.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)

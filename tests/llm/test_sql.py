"""Corpus queries against their SQL on the smallest tables."""

import pytest

from pairlab.llm import queries
from tests.test_queries import SF, duck, plain  # noqa: F401

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):  # noqa: F811
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    assert plain(df.select(columns).collect()) == plain(duck.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall())

"""The text queries that SQL can express, against DuckDB."""

import pytest

from tests.compare import compare, database
from tidelog.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sf, name):
    compare(spark, database(sf), QUERIES[name], ORACLE_SQL[name], sf)

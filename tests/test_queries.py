"""Every registered query of the core against DuckDB, or at least that it gives rows."""

import pytest

from tests.compare import compare, database
from tidelog.plans.oracle import ORACLE_SQL
from tidelog.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return database(sf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLE_SQL)))
def test_against_sql(spark, con, sf, name):
    assert compare(spark, con, QUERIES[name], ORACLE_SQL[name], sf) > 0  # no rows would show nothing


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_without_sql(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_every_statement_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_entry_without_the_text_operators(monkeypatch):
    import __spark_entry__ as e

    monkeypatch.setattr(e, "_llm", lambda: None)
    assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) == set(ORACLE_SQL)

"""Every registered query against its independent SQL, value by value."""

import pytest
from conftest import SMALL

import __spark_entry__ as book
import check
from querybook.oracles import ORACLES
from querybook.queries import QUERIES


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(book.oracle_sql()) <= set(book.queries())


@pytest.mark.parametrize("name", list(book.oracle_sql()))
def test_query(spark, con, name):
    assert check.compare(spark, con, SMALL, name) is None


def test_entry(spark):
    result = book.entry(spark)
    assert result.columns == ["state", "district", "adult_enrolments", "anomaly", "risk_score"]
    assert result.count() > 0

"""Every registered query of the core against its SQL on the smallest tables."""

import oracle_check
import pytest

import __spark_entry__ as entry
from emberline.plans import catalog

QUERIES = sorted(catalog.QUERIES)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(entry.queries()) and set(QUERIES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_oracle(spark, sf, name):
    assert oracle_check.compare(spark, oracle_check.connect(sf), name, sf) == []


def test_entry_has_rows(spark):
    assert not entry.entry(spark).isEmpty()

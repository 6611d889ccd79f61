"""Every registered query outside llm against its DuckDB twin; those without one by their rows."""

import oracle
import pytest

from paperloom.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, name):
    assert oracle.compare(spark, SF, catalogue.QUERIES[name], catalogue.ORACLES[name]) in (None, "no rows")  # this scale lacks some cases


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES) - {"retrieval_pipeline"}))
def test_query_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

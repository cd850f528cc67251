import pytest
from compare import oracle, spark_rows

import __spark_entry__ as entry
from causalframe.plans import catalog
from conftest import SMALL


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["key", "siblings", "tombs", "ids"] and rows.count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_oracle(spark, name):
    assert spark_rows(catalog.QUERIES[name](spark, SMALL)) == oracle(catalog.ORACLE_SQL[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0

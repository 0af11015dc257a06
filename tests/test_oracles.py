"""Every query of the library with SQL against DuckDB."""

import pytest
from conftest import same_rows

from svloom.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_oracle(spark, sf, name):
    same_rows(catalogue.QUERIES[name](spark, sf), catalogue.ORACLE_SQL[name], sf)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

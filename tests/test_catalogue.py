"""Every registered query of the engine against its SQL."""

import pytest
from conftest import SF
from oracle import same

from sediment import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, duck, name):
    assert same(catalogue.QUERIES[name](spark, SF), duck.sql(catalogue.SQL[name]))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())

import pytest

from tallyworks.llm.queries import oracle_sql, queries

from ..oracle import connection, differences


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert differences(spark, sf_dir, name, queries()[name], oracle_sql()[name], connection(sf_dir)) == ""

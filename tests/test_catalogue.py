import pytest
from compare import assert_same

from gritstone.plans import catalogue


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_matches_sql(name, spark, sf_dir, duck):
    assert_same(catalogue.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(catalogue.ORACLES[name]).df())


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)

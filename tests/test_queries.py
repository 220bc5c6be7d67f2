"""Every core query runs; those with a SQL twin agree with it on the smallest tables."""

import pytest

from folioscope.plans import catalogue
from tests.conftest import same_rows


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, small, name):
    got = catalogue.QUERIES[name](spark, small).toPandas()
    if name in catalogue.ORACLES:
        same_rows(got, duck.execute(catalogue.ORACLES[name]).df())
    else:
        assert len(got.columns)


def test_oracles_belong_to_queries():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)

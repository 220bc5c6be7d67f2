"""Every query for training data runs; those with a SQL twin agree with it."""

import pytest

from folioscope.llm import oracles, queries
from tests.conftest import same_rows


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, small, name):
    got = queries.QUERIES[name](spark, small).toPandas()
    if name in oracles.ORACLES:
        same_rows(got, duck.execute(oracles.ORACLES[name]).df())
    else:
        assert len(got.columns)

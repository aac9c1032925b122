"""Every registered query against its SQL; those without SQL run and have a stable schema."""

import pytest

from taskloom.plans import registry
from tests.oracle import connect, same

SF = "/root/testdata/sf0.001"
NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    if name in registry.oracle_sql():
        same(df, con, registry.oracle_sql()[name])
    else:
        assert df.schema == registry.queries()[name](spark, SF).schema
        df.count()

"""Every query of the engine against its SQL on DuckDB, over the smallest test data."""

import pytest

from quern.queries import ORACLE, QUERIES
from tests.compare import connect, differs
from tests.conftest import SF


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE:
        assert not differs(df, con, ORACLE[name])
    else:
        assert df.count() > 0

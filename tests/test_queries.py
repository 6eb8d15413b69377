"""Every registered query of the core: against its oracle, or that it runs."""

import pytest

from basalt.plans.registry import ORACLE_SQL, QUERIES
from compare import same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    df = QUERIES[name](spark, data)
    if name in ORACLE_SQL:
        same(df, ORACLE_SQL[name], data)
    else:
        assert df.count() > 0

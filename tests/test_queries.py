"""Every registered query of the core runs, and equals its SQL where it has one."""

import pytest

from tests.compare import DATA, expected, rows_of
from tidescope import plans

SIZE = "sf0.001"


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, name):
    found = plans.QUERIES[name](spark, str(DATA / SIZE))
    rows = rows_of(found.columns, found.collect())
    assert rows
    if name in plans.ORACLE_SQL:
        names, want = expected(plans.ORACLE_SQL[name], SIZE)
        assert sorted(found.columns) == names
        assert rows == want


def test_every_sql_belongs_to_a_query():
    assert set(plans.ORACLE_SQL) <= set(plans.QUERIES)

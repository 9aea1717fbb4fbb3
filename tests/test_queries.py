"""Every query has an SQL form and equals it."""

import pytest

from msgpulse import plans
from tests.compare import connect, differences

NAMES = sorted(plans.queries())


@pytest.fixture(scope="module")
def conn(sf):
    return connect(sf)


@pytest.mark.parametrize("name", [n for n in NAMES if n in plans.oracle_sql()])
def test_equals_sql(spark, conn, sf, name):
    assert differences(spark, conn, plans.queries()[name], plans.oracle_sql()[name], sf) == ""


def test_every_query_has_sql():
    assert set(NAMES) == set(plans.oracle_sql())


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["ticker", "day", "bullish_ratio", "n"]

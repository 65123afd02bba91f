import pytest
from oracle import compare, connect

from panelweave.jobs.catalog import QUERIES
from panelweave.jobs.oracles import ORACLES

NO_SQL = {"distribution_fits", "spi", "gof_summary"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf_dir, con, name):
    got, want = compare(spark, con, QUERIES[name], ORACLES[name], sf_dir)
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_every_query_has_sql_or_is_listed():
    assert QUERIES.keys() - ORACLES.keys() == NO_SQL and not ORACLES.keys() - QUERIES.keys()

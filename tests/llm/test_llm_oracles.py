import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
from oracle import compare, connect  # noqa: E402

from panelweave.llm.queries import ORACLES, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    got, want = compare(spark, connect(sf_dir), QUERIES[name], ORACLES[name], sf_dir)
    assert got == want and got[1]


def test_one_query_for_each_operator():
    assert [int(n.split("_")[0][2:]) for n in QUERIES] == list(range(1, 14)) and all(q.__doc__ for q in QUERIES.values())

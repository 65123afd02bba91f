from panelweave.config import FIXTURE, N_SURROGATES
from panelweave.jobs import catalog


def test_queries_draw_as_many_surrogates_as_published():
    assert FIXTURE.surrogates == catalog.SWEEP_SURROGATES == N_SURROGATES == 1000

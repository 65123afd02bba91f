from panelweave.llm import mixing, queries
from panelweave.sources.tables import table


def test_mixing_moves_whole_documents(spark, sf_dir, monkeypatch):
    moved, replicate = [], mixing.replicate
    monkeypatch.setattr(mixing, "replicate", lambda docs: moved.append(docs.columns) or replicate(docs))
    queries.op5_poisson_mixing(spark, sf_dir)
    assert moved == [table(spark, sf_dir, "documents").columns]

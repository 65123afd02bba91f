"""Stages that stream sorted rows give the same results however the rows fall into Arrow batches."""

import random

import pytest
from test_exact_line_mixing import brute_lines
from test_simhash import brute as brute_simhash
from test_suffix_dedup import brute as brute_suffix
from test_suffix_dedup import cases, result
from util import frame

from panelweave.llm import line_dedup, simhash, suffix_dedup


@pytest.fixture(params=[1, 7])
def small_batches(spark, request):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(request.param))
    yield
    spark.conf.set(key, before)


def test_results_do_not_depend_on_batches(spark, small_batches, monkeypatch):
    rng = random.Random(21)
    rows = list({i: (i, t) for i, t in cases(rng, 60)}.values())
    assert result(suffix_dedup.remove_repeats(frame(spark, rows))) == brute_suffix(rows)
    lines = [(i, "\n".join(rng.choices([f"a line with number {k}" for k in range(15)], k=5))) for i in range(25)]
    got = line_dedup.drop_repeated_lines(frame(spark, lines)).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got), key=str) == brute_lines(lines)
    near = [(i, " ".join(rng.choices(["aa", "bb", "cc"], k=6))) for i in range(60)]
    assert sorted(map(tuple, simhash.near_duplicates(frame(spark, near)).collect()), key=str) == brute_simhash(near)

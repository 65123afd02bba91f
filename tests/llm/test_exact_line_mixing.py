import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from util import frame

from panelweave.llm import exact_dedup, line_dedup, mixing

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(rng, n):
    base = ["Some text É", "some TEXT é", "SOME text É", "", "x" * 30_000, "line one here\nline two here\n"]
    return [(rng.randint(0, 60), rng.choice([*base, None, f"own {i}"])) for i in range(n)]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("runs,fan_in", [(64, 4), (5, 2), (1, 8)])
def test_exact_groups_equal_brute_force(spark, keep, runs, fan_in):
    rows = texts(random.Random(4), 150) + [(None, "alone"), (None, None)]
    got = sorted(map(tuple, exact_dedup.group_texts(frame(spark, rows), keep=keep, runs=runs, fan_in=fan_in).collect()), key=str)
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOW), []).append(i)
    want = []
    for i, t in rows:
        g = groups[(t or "").translate(LOW)]
        known = [x for x in g if x is not None]
        k = (min if keep == "smallest" else max)(known) if known else None
        want.append((i, k, len(g), i == k, hashlib.sha256((t or "").translate(LOW).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_exact_empty_and_clashing_columns(spark):
    assert exact_dedup.group_texts(frame(spark, [])).count() == 0
    clash = frame(spark, [(1, "a")]).withColumnRenamed("lang", "digest").withColumnRenamed("source", "run")
    assert exact_dedup.group_texts(clash).first().kept


def test_exact_runs_are_merged_in_sorted_order(spark, monkeypatch):
    """Above the leaves, a run is exchanged by range, sorted once, and aggregated as a sorted stream without another shuffle."""
    plans = []
    keep = exact_dedup.materialize
    monkeypatch.setattr(exact_dedup, "materialize", lambda df, label: (plans.append((label, df._jdf.queryExecution().executedPlan().toString())), keep(df, label))[1])
    assert exact_dedup.group_texts(frame(spark, texts(random.Random(5), 60))).count() == 60
    merges = [p for label, p in plans if label == "runs"]
    assert len(merges) == 4  # leaves, then 64 to 16 to 4 to 1
    for p in merges:
        final = p.split("Initial Plan")[0]
        assert "SortAggregate" in final and "HashAggregate" not in final and final.count("Exchange") == 1


def brute_lines(rows, least=10):
    key = lambda line: line.strip(line_dedup.BLANKS).translate(LOW)
    big = 1 << 63
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                holders.setdefault(key(line), set()).add(big if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) in holders and len(holders[key(x)]) >= 2 and min(holders[key(x)]) < (big if i is None else i))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_lines_equal_brute_force(spark):
    rng = random.Random(6)
    pool = ["All rights reserved", " all RIGHTS reserved\t", "short", "", "ÉÉÉÉÉÉÉÉÉÉ éé", "éééééééééé éé", "nine char", "ten chars!"] + [f"line number {k}" for k in range(40)]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 12)))) for i in range(80)]
    rows += [(500, None), (501, "All rights reserved\n" * 3000), (None, "ten chars!\nunheard of line"), (3, "line number 1"), (7, "only in here, twice\nonly in here, twice")]
    got = line_dedup.drop_repeated_lines(frame(spark, rows))
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect()), key=str) == brute_lines(rows)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_lines", "n_dropped"]
    probed = line_dedup.drop_repeated_lines(frame(spark, rows), hot_lines=1)  # no line is hot: all go through the arrays
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in probed.collect()), key=str) == brute_lines(rows)
    clash = frame(spark, [(1, "a line that repeats"), (2, "a line that repeats")]).withColumnRenamed("lang", "n_lines").withColumnRenamed("source", "_drop")
    assert sorted(r.n_dropped for r in line_dedup.drop_repeated_lines(clash).collect()) == [0, 1]
    assert line_dedup.drop_repeated_lines(frame(spark, [])).count() == 0


def test_perfect_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        hashed = line_dedup.PerfectHash.build(keys)
        assert sorted(hashed.index(keys).tolist()) == list(range(len(keys)))
        others = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
        assert ((hashed.index(others) >= -1) & (hashed.index(others) < max(1, len(keys)))).all()


def test_copies_follow_the_poisson_distribution(spark):
    rows = [(i, f"t{i}", "en", "big" if i % 3 else ("small" if i % 2 else None)) for i in range(3000)]
    docs = frame(spark, rows)
    got = mixing.replicate(docs, seed=7).collect()
    sources = Counter(r[3] for r in rows)
    rates = {s: len(rows) / (3 * n) for s, n in sources.items()}

    def copies(i, rate):
        u = int(hashlib.md5(f"7:{i}".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-rate)
        total = p
        while total <= u:
            k += 1
            p *= rate / k
            total += p
        return k

    want = {i: n for i, _, _, s in rows if (n := copies(i, rates[s]))}
    assert Counter(r.doc_id for r in got) == want
    assert all(r.n_copies == want[r.doc_id] and 1 <= r.copy_no <= r.n_copies for r in got)
    shares = Counter(r.source for r in got)
    assert all(abs(n - 1000) < 150 for n in shares.values()) and len({(r.doc_id, r.copy_no) for r in got}) == len(got)
    ids = [r.doc_id for r in got]
    assert np.corrcoef(np.arange(len(ids)), ids)[0, 1] ** 2 < 0.01


def test_weights_targets_and_odd_rows(spark, monkeypatch):
    docs = frame(spark, [(i, "t", "en", "ab"[i % 2]) for i in range(400)] + [(None, None, None, "c"), (None, None, None, "c")]).withColumn("rate", F.lit("own")).withColumn("_u", F.lit(2)).withColumn("_source", F.lit("x"))
    weights = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("zzz", 5.0)], "source string, weight double")
    first = sorted(map(str, mixing.replicate(docs, weights, 4000).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.replicate(docs, weights, 4000).collect())) == first
    count = Counter("a" if " source='a'" in r else "b" if " source='b'" in r else "c" for r in first)
    assert count["c"] == 0 and abs(count["a"] - 3000) < 250 and abs(count["b"] - 1000) < 150
    assert mixing.replicate(frame(spark, [])).count() == 0
    assert mixing.replicate(docs, weights, 0).count() == 0


def test_large_rates_repeat_rows_in_full(spark):
    rows = [(k, "x", None, "big") for k in range(1, 5000)] + [(-1, "y", None, "one"), (-2, "z", None, "two"), (-3, "z", None, "two")]
    found = mixing.replicate(frame(spark, rows), target_rows=900_000).groupBy("source", "doc_id").count().collect()
    by = {r.doc_id: r["count"] for r in found if r.source != "big"}
    assert abs(by[-1] - 300_000) < 8 * 300_000**0.5 and all(abs(by[k] - 150_000) < 8 * 150_000**0.5 for k in (-2, -3))

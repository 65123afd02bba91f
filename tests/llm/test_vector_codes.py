import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException

from panelweave.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=8, entries=16, rounds=6):
    """Rows (vec_id, code, error, label_error, codebooks_sha256) by plain loops over whole numbers."""
    kept = [(i, [math.floor(4096 * np.float64(np.float32(x))) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, len(r[1]), r[1]))
    kept = [r for r in kept if len(r[1]) == len(first[0][1])] if kept else []
    first = [r for r in first if len(r[1]) == len(first[0][1])]
    width = len(first[0][1]) // parts if first else 0
    books = [[r[1][p * width : (p + 1) * width] for r in first[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        found = [[nearest(p, v[p * width : (p + 1) * width])[1] for p in range(parts)] for _, v, _ in kept]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [v[p * width : (p + 1) * width] for (_, v, _), f in zip(kept, found, strict=True) if f[p] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    told = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    out = []
    for i, v, lab in kept:
        near = [nearest(p, v[p * width : (p + 1) * width]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in near), sum(d for d, _ in near), lab))
    total = {lab: sum(r[2] for r in out if r[3] == lab) for *_, lab in out}
    return sorted(((i, c, d, total[lab], told) for i, c, d, lab in out), key=str)


def check(spark, rows, parts=8):
    got = vc.compress(spark.createDataFrame(rows, SCHEMA).repartition(3), parts=parts).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, parts)
    return got


def test_equals_plain_loops(spark):
    rng = random.Random(5)
    rows = [(i * 3 - 40, [rng.gauss(0, 0.2) for _ in range(16)], rng.choice([0, 1, None])) for i in range(300)]
    rows += [(1000 + i, [rng.choice([0.25, -0.25]) for _ in range(16)], 2) for i in range(60)]  # ties and repeated vectors
    rows += [(2000 + i, rows[i][1], None) for i in range(200)]
    check(spark, rows)


def test_rows_that_are_dropped_and_ids_that_repeat(spark):
    v = [0.5, -0.125] * 8
    rows = [(1, None, 1), (2, [], 1), (3, [*v[:-1], None], 1), (4, [*v[:-1], math.nan], 1), (5, [*v[:-1], math.inf], 1), (6, [*v[:-1], -math.inf], None)]
    rows += [(7, v, None), (7, [0.25] * 16, None), (7, v, 3), (None, [1.5] * 16, 3), (8, [1.0] * 8, 3), (9, [-0.0] * 16, 3)]
    got = check(spark, rows)
    assert sorted(str(r.vec_id) for r in got) == ["7", "7", "7", "9", "None"]


@pytest.mark.parametrize("n", [0, 1, 2, 15, 17])
def test_few_rows(spark, n):
    check(spark, [(i, [0.1 * i, -0.3 * i, 0.7, 0.01 * i * i], i % 2) for i in range(n)], parts=2)


def test_names_that_clash(spark):
    rows = [(i, [0.5 * i] * 8, 1) for i in range(5)]
    table = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA + ", id int, steps int, n int")
    assert sorted(map(tuple, vc.compress(table).collect()), key=str) == brute(rows)


def test_what_cannot_be_cut_or_counted_is_refused(spark):
    with pytest.raises(ValueError, match="equal parts"):
        vc.compress(spark.createDataFrame([(1, [0.5] * 9, 1)], SCHEMA))
    with pytest.raises(PySparkException, match="beyond"):
        vc.compress(spark.createDataFrame([(1, [1e30] * 8, 1)], SCHEMA)).count()
    with pytest.raises(ValueError, match="64"):
        vc.Slices(np.zeros((65, 2)))


NUMBERS = st.one_of(st.integers(-4, 4), st.integers(-(2**26), 2**26))


@settings(max_examples=200, deadline=None)
@given(st.data(), st.integers(1, 64), st.integers(1, 6))
def test_slices_find_the_nearest_with_the_lower_index_at_ties(data, k, d):
    draw = lambda n: np.array(data.draw(st.lists(st.lists(NUMBERS, min_size=d, max_size=d), min_size=n, max_size=n)), np.int64)
    entries, x = draw(k), draw(5)
    slices = vc.Slices(entries)
    distance = ((x[:, None] - entries[None]) ** 2).sum(2)
    index, best = slices.nearest(x)
    assert index.tolist() == distance.argmin(1).tolist() and best.tolist() == distance.min(1).tolist()
    masks = slices.candidates(x, np.array([0, 1, 5, 1000, 2**27]))
    for row, (mask, radius) in enumerate(zip(masks.tolist(), (0, 1, 5, 1000, 2**27), strict=True)):
        assert [mask >> e & 1 for e in range(k)] == (np.abs(x[row] - entries).max(1) <= radius).astype(int).tolist()


def test_slices_leave_most_entries_unmeasured():
    rng = np.random.default_rng(3)
    entries = rng.integers(-4096, 4096, (16, 8))
    x = entries[rng.integers(0, 16, 2000)] + rng.integers(-600, 600, (2000, 8))
    slices = vc.Slices(entries)
    tight = slices.candidates(x, np.sqrt(slices.nearest(x)[1].astype(float)).astype(np.int64) + 1)
    assert np.bitwise_count(tight).mean() < 1.5

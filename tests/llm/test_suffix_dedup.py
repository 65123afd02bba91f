import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from util import frame

from panelweave.llm import suffix_dedup as sd


def brute(rows):
    big = 1 << 63
    order = sorted(range(len(rows)), key=lambda r: (big if rows[r][0] is None else rows[r][0], hashlib.sha256((rows[r][1] or "").encode()).hexdigest()))
    seen, out, known = set(), [], {}
    for r in order:
        i, text = rows[r]
        if (i, text) in known:
            out.append(known[i, text])
            continue
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                gone[p : p + 100] = True
            seen.add(w)
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        known[i, text] = (i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
        out.append(known[i, text])
    return sorted(out, key=str)


def result(df):
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")]
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def cases(rng, n):
    vocab = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(300)]
    passages = [" ".join(rng.choices(vocab, k=rng.randint(15, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            cut = rng.randint(0, 20)
            parts.append(p[cut : len(p) - rng.randint(0, 20)] if rng.random() < 0.7 else " ".join(rng.choices(vocab, k=30)))
        rows.append((rng.randint(0, 10**6), rng.choice([" ", "\n", ""]).join(parts)))
    return rows


@pytest.mark.parametrize("large_group", [sd.LARGE_GROUP, 3])
def test_rows_equal_brute_force(spark, large_group):
    rng = random.Random(11)
    rows = cases(rng, 120)
    rows += [(-5, "ab" * 400), (7, "x" * 1500), (8, "y" + "x" * 300), (9, None), (10, ""), (11, "x" * 99), (12, "x" * 100), (None, "x" * 120), (None, rows[0][1])]
    rows += [(50, "same text " * 30), (50, "same text " * 30), (50, "other text " * 30), (3, "\x00" * 250), (4, "a\x00b" * 90)]
    assert result(sd.remove_repeats(frame(spark, rows), large_group=large_group)) == brute(rows)


@pytest.mark.parametrize("segment", [sd.SEGMENT, 257, 100])
def test_long_texts_in_segments(spark, segment):
    rng = random.Random(5)
    base = "".join(rng.choices("abcdefgh", k=3000))
    rows = [(1, base), (2, "zz" + base[500:2500] + "q" * 50 + base[:400]), (3, base)]
    data = [t.encode() for _, t in rows]
    whole = sd.sample(np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(x) for x in data]))
    assert len(whole[0]) < sum(map(len, data)) * 0.06
    assert result(sd.remove_repeats(frame(spark, rows), segment=segment)) == brute(rows)


def test_names_of_other_columns_do_not_matter(spark):
    rows = [(1, "same words " * 30), (2, "same words " * 30)]
    clash = frame(spark, rows).withColumnRenamed("lang", "seed").withColumnRenamed("source", "spans").withColumn("id", F.lit("x")).withColumn("at", F.lit(0))
    assert result(sd.remove_repeats(clash)) == brute(rows)


def test_empty_table(spark):
    assert sd.remove_repeats(frame(spark, [])).count() == 0


def test_deep_shallow_order_and_common_lengths():
    rng = random.Random(2)
    strings = [bytes(rng.choices(b"ab\x00", k=rng.randint(0, 40))) for _ in range(400)] + [b"a" * k for k in range(60)] + [b"a" * 30] * 3
    group = np.sort([rng.randint(0, 3) for _ in strings])
    order, common = sd.deep_shallow(group, strings)
    got = [(group[k], strings[k]) for k in order]
    assert got == sorted(got)
    for n in range(1, len(order)):
        want = sd._common(got[n - 1][1], got[n][1]) if got[n - 1][0] == got[n][0] else -1
        assert common[n] == want

import random
import re

import numpy as np
import pytest
from util import frame
from xxhash import xxh64_intdigest

from panelweave.llm import simhash


def brute_fp(text, words=3):
    found = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    low = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in found]
    if not low:
        return 0
    grams = [" ".join(low[i : i + words]) for i in range(len(low) - words + 1)] or [" ".join(low)]
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, most=3):
    fps = [brute_fp(t) for _, t in rows]
    big = 1 << 62
    label = [i if i is not None else big for i, _ in rows]
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                if (fps[a] ^ fps[b]).bit_count() <= most and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return sorted(((i, f"{f:016x}", c if c != big else None) for (i, _), f, c in zip(rows, fps, label, strict=True)), key=str)


def test_rows_equal_brute_force(spark):
    rng = random.Random(3)
    vocab = ["Ab", "cd", "éF", "gh", "ij", "kl", "mn", "OP"]
    base = [" ".join(rng.choices(vocab, k=300)) for _ in range(6)]
    rows = [(1000 - i, t) for i, t in enumerate(base)]
    for k in range(60):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((k + 1, "\t".join(words) if k % 2 else " ".join(words).upper()))
    rows += [(2000, None), (2001, ""), (1999, " \n "), (2002, "one"), (2003, "ONE"), (2004, "one two"), (None, "one"), (None, "alone here now"), (1, base[0])]
    got = sorted(map(tuple, simhash.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == brute(rows)
    kept = simhash.keep_first(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    firsts = {i for i, _, c in brute(rows) if i == c}
    assert {r.doc_id for r in kept.collect()} == firsts


def test_empty_table(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def _classes(fps, links):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("leaf", [2, 32])
def test_index_finds_the_classes_of_every_run(monkeypatch, leaf):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "PAIRS", 3000)
    rng = random.Random(5)
    runs = [[rng.getrandbits(64)] for _ in range(5)] + [[f := rng.getrandbits(64), f ^ 5, f ^ 7 << 9, rng.getrandbits(64)] for _ in range(20)]
    runs.append(list({rng.getrandbits(64) & 0xFFFF for _ in range(600)}))
    runs.append([1 << 60 | 1 << i | 1 << j for i in range(20, 50) for j in range(i)])
    fps, of, want = [], [], []
    for k, members in enumerate(runs):
        members = sorted(set(members), key=simhash_rank)
        want += [(x, y) for n, x in enumerate(members) for y in members[:n] if (x ^ y).bit_count() <= 3]
        fps += members
        of += [k] * len(members)
    a, b = simhash.GrayIndex(np.array(fps, np.uint64), np.array(of)).links(3)
    got = list(zip(a.tolist(), b.tolist(), strict=True))
    assert all((x ^ y).bit_count() <= 3 for x, y in got) and len(got) < len(fps)
    assert _classes(fps, got) == _classes(fps, want)


def test_far_groups_are_pruned_by_their_shared_bits():
    fps = sorted([(k % 2) * 0xFF00 | (k >> 1 & 15) for k in range(32)] + [0xFF << 40 | k for k in range(32)], key=simhash_rank)
    index = simhash.GrayIndex(np.repeat(np.array(sorted(set(fps), key=simhash_rank), np.uint64), 1), np.zeros(len(set(fps)), int))
    every = len(index.levels[0][0])
    pairs = sum(len(a) for a, _ in index.leaf_pairs(3))
    assert every * (every + 1) // 2 >= pairs >= every


def test_crowded_patterns_are_factored_once_more(spark):
    rng = random.Random(8)
    base = rng.getrandbits(64)
    fps = {base} | {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(400)} | {rng.getrandbits(64) for _ in range(200)}
    frame_ = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    want = _classes(sorted(fps), [(x, y) for x in fps for y in fps if x < y and (x ^ y).bit_count() <= 3])
    for split in (20, 50_000):
        got = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.fingerprint_links(frame_, split=split).collect()]
        assert all((x ^ y).bit_count() <= 3 for x, y in got) and _classes(sorted(fps), got) == want
    for mask, four in zip(simhash.root_masks(), simhash._split_masks(), strict=True):
        assert all((m % (1 << 64)).bit_count() == 37 and m % (1 << 64) & mask == mask for m in four)


def test_frequent_fingerprints_are_placed_like_the_others(spark, monkeypatch):
    rows = [(k, "the same text as ever") for k in range(50)] + [(k, f"another text {k} of words {k * 7}") for k in range(50, 80)]
    for hot in (1, 10_000):
        monkeypatch.setattr(simhash, "HOT", hot)
        assert sorted(map(tuple, simhash.near_duplicates(frame(spark, rows)).collect()), key=str) == brute(rows)


def simhash_rank(f):
    for s in (1, 2, 4, 8, 16, 32):
        f ^= f >> s
    return f


def test_masks_leave_no_three_bits_uncovered():
    rng, masks = random.Random(7), simhash.root_masks()
    assert len(masks) == 16 and all(m.bit_count() == 28 for m in masks)
    for _ in range(20000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        assert any(not diff & m for m in masks)

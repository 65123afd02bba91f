import random
from collections import Counter

import numpy as np
import pytest
from util import frame

from panelweave.llm import jaccard, simhash


def brute_firsts(rows, least=0.8):
    sets = [jaccard.shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                label[max(find(a), find(b))] = min(find(a), find(b))
    classes = {}
    for k, (i, _) in enumerate(rows):
        classes.setdefault(find(k), []).append(i if i is not None else 1 << 62)
    return Counter(min(ids) for ids in classes.values())


def edited(words, rng, low, high):
    """A copy with single words replaced until the similarity lies in a range."""
    old = jaccard.shingles(" ".join(words))
    while True:
        new = list(words)
        for _ in range(len(words)):
            new[rng.randrange(len(new))] = f"new{rng.getrandbits(40)}"
            s = jaccard.similarity(old, jaccard.shingles(" ".join(new)))
            if s < low:
                break
            if s < high:
                return " ".join(new)


def test_planted_pairs_from_080_up_are_found_and_others_stay(spark):
    rng, rows = random.Random(11), []
    for k, (low, high) in enumerate([(0.8, 0.85), (0.85, 0.9), (0.9, 0.95), (0.7, 0.8)] * 25):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(120, 500))]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, edited(words, rng, low, high).upper())]
    kept = {r.doc_id for r in jaccard.keep_first(frame(spark, rows)).collect()}
    assert kept == {2 * k for k in range(100)} | {2 * k + 1 for k in range(3, 100, 4)}
    old = {r.doc_id for r in simhash.keep_first(frame(spark, rows)).collect()}
    assert len(old) > 150  # three of 64 bits leave most of them


def test_classes_equal_brute_force(spark):
    rng, rows = random.Random(12), []
    for g in range(6):
        words = [f"w{rng.randrange(300)}" for _ in range(200)]
        for _ in range(20):
            rows.append((len(rows) * 7919 % 1009, " ".join(words)))
            words = edited(words, rng, 0.78, 0.9).split() if g % 2 else words[:190] + [f"x{rng.random()}" for _ in range(10)]
    rows += [(2000, None), (2001, ""), (1999, " \n "), (2002, "one"), (2003, "ONE"), (2004, "one two"), (None, "one"), (None, "alone here now")]
    kept = jaccard.keep_first(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert Counter(r.doc_id if r.doc_id is not None else 1 << 62 for r in kept.collect()) == brute_firsts(rows)


def test_one_row_stays_of_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "A  b"), (None, "c d"), (None, "c d"), (None, "e f"), (2, "e f"), (1, "g h")]
    kept = jaccard.keep_first(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.text.lower().split()[0]) for r in kept) == Counter([(1, "a"), (None, "c"), (2, "e"), (1, "g")])
    assert jaccard.keep_first(frame(spark, [])).count() == 0


def test_columns_of_any_name_and_very_long_texts(spark):
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [(1, long, "mine"), (2, long.upper(), "yours"), (3, long + " and more", "theirs"), (4, "other words altogether", "4")]
    docs = spark.createDataFrame([(*r, r[2], 7, r[2]) for r in rows], "doc_id long, text string, _own string, own string, _place int, place string")
    kept = sorted(map(tuple, jaccard.keep_first(docs).select("doc_id", "_own", "own", "_place", "place").collect()))
    assert kept == [(1, "mine", "mine", 7, "mine"), (4, "4", "4", 7, "4")]


def family(rng, n):
    """Texts of one template, each with edits of its own that single ones pass on: most are alike by 0.5 to 0.8, few are linked."""
    base, texts = [f"w{rng.randrange(5000)}" for _ in range(150)], []
    for k in range(n):
        new = list(texts[rng.randrange(k)] if k and rng.random() < 0.7 else base)
        for _ in range(rng.randint(2, 5)):
            new[rng.randrange(150)] = f"w{rng.randrange(5000)}"
        texts.append(new)
    return [(7919 * k % 10007, " ".join(t)) for k, t in enumerate(texts)]


def test_checks_on_texts_do_not_grow_with_the_square_of_a_family(spark, monkeypatch):
    checked, similar = [], jaccard._similar

    def counted(pairs, *rest):
        checked.append(pairs.count())
        return similar(pairs, *rest)

    monkeypatch.setattr(jaccard, "_similar", counted)
    made = []
    for n in (150, 450):
        checked.clear()
        rows = family(random.Random(31), n)
        kept = jaccard.keep_first(frame(spark, rows))
        assert Counter(r.doc_id for r in kept.collect()) == brute_firsts(rows)
        made.append(sum(checked))
    assert made[1] < 3 * 450 and made[1] < 5 * made[0]


@pytest.mark.parametrize("size", [1, 4, 5, 40, 300, 1500])
def test_pairs_at_08_pass_the_bounds_and_most_below_do_not(spark, size):
    rng, rows, want = random.Random(size), [], set()
    for k in range(40):
        both = -(-8 * size // 10) - k % 2 * (size > 30) * size // 20  # the odd ones lie below
        every = [f"s{rng.getrandbits(60)}" for _ in range(2 * size - both)]
        cut = both + (len(every) - both + 1) // 2 if 10 * both < 8 * len(every) else len(every) - (len(every) - both) // 2
        a, b = every[:cut], every[:both] + every[cut:]
        if not b:
            continue
        rows += [(bytes([k, 0]), " ".join(a)), (bytes([k, 1]), " ".join(b))]
        if jaccard.similarity(set(a), set(b)) >= 0.8:
            want.add(k)
    rare = jaccard._rarest(jaccard._shingled(spark.createDataFrame(rows, "same binary, text string"), 1), 0.8)
    met = rare.alias("l").join(rare.alias("r"), "g").where("l.same < r.same").where(jaccard._enough("l", "r", 0.8))
    got = {r.a[0] for r in met.selectExpr("l.same a", "r.same b").collect() if r.a[0] == r.b[0]}
    assert want <= got
    assert len(got) == len(want) or size > 300


def test_odd_bits_never_differ_in_more_than_the_texts(spark):
    rng = random.Random(8)
    pairs = [[" ".join(f"s{rng.randrange(60)}" for _ in range(rng.randint(0, 80))) for _ in range(2)] for _ in range(30)]
    rows = [(bytes([k, j]), t) for k, both in enumerate(pairs) for j, t in enumerate(both)]
    odd = {bytes(r.same): np.array(r.odd).view(np.uint64) for r in jaccard._shingled(spark.createDataFrame(rows, "same binary, text string"), 2).collect()}
    for k, (x, y) in enumerate(pairs):
        assert np.bitwise_count(odd[bytes([k, 0])] ^ odd[bytes([k, 1])]).sum() <= len(jaccard.shingles(x, 2) ^ jaccard.shingles(y, 2))

import random
import re

import numpy as np
from pyspark.sql import functions as F
from util import frame

from panelweave.llm import outliers

WORD = r"[^\x20\x09-\x0D]+"


def brute_statistics(text):
    words = re.findall(WORD, text or "")
    seen = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)}
    lines, dup, known = (text or "").split("\n"), 0, set()
    for line in lines:
        if re.search(WORD, line):
            dup += line in known
            known.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def corpus(rng, n):
    vocab = ["".join(rng.choices("abcdefghijklmnopé", k=rng.randint(2, 9))) for _ in range(400)]
    rows = []
    for i in range(n):
        words = rng.choices(vocab, k=rng.randint(12, 200))
        if i % 25 == 0:
            words = [w + "***" for w in words]
        if i % 25 == 1:
            words = (words[:3] * 40)[:100]
        text = " ".join(words[:40]) + "\n" + "\t".join(words[40:])
        rows.append((i, text, rng.choice(["en", "fr"]), "hot" if i % 3 else "cold"))
    return rows


def test_base_statistics_equal_brute_force(spark):
    rng = random.Random(9)
    rows = corpus(rng, 60) + [(900, None), (901, ""), (902, " \n\t \x0b"), (903, "a b c d e f g h i j k"), (904, "a b c d e\n" * 4000), (905, "x\nx\n \n \nX\nx"), (906, "é# " * 20), (None, "a b c d e a b c d e"), (903, "a b")]
    got = outliers.judge(frame(spark, rows))
    assert got.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept"]
    got = sorted((tuple(r)[:7] for r in got.collect()), key=str)
    want = []
    for i, t, *_ in rows:
        s = brute_statistics(t)
        want.append((i, *s, s[0] < 10 or 100 * s[4] > 20 * s[0]))
    assert got == sorted(want, key=str)


def brute_distances(vectors):
    """Two starts, concentration steps by bins of distance, the smaller determinant: as the operator, in numpy."""
    ridge = np.diag([(1000 * v) ** 2 for v in outliers.VECTOR.values()])

    def estimate(part):
        mean = part.mean(axis=0)
        return mean, (part.T @ part) / len(part) - np.outer(mean, mean) + ridge * (1 + outliers.PRIOR_ROWS / len(part))

    def distance(e):
        d = vectors - e[0]
        return np.einsum("ij,jk,ik->i", d, np.linalg.inv(e[1]), d)

    everyone = estimate(vectors)
    band = (np.abs(vectors - everyone[0]) <= np.sqrt(np.diag(everyone[1]))).all(axis=1)
    best = None
    for e in (everyone, estimate(vectors[band])):
        for _ in range(outliers.MAX_STEPS):
            bins = np.floor(np.log(distance(e) + 1e-6) * outliers.BINS)
            limit = np.sort(bins)[int(np.ceil(len(bins) * outliers.SUBSET)) - 1]
            e = estimate(vectors[bins <= limit])
        det = np.linalg.slogdet(e[1])[1]
        if best is None or det < best[0]:
            best = (det, distance(e))
    return best[1]


def test_distances_equal_numpy_and_junk_goes(spark):
    rows = corpus(random.Random(10), 900)
    docs = frame(spark, rows)
    got = {r.doc_id: r for r in outliers.judge(docs).collect()}
    stats = {r.id: r for r in outliers._transformed(outliers.word_statistics(docs)).collect()}
    names = list(outliers.VECTOR)
    for lang in ("en", "fr"):
        for source in ("hot", "cold"):
            ids = [i for i, _, g, s in rows if g == lang and s == source and not got[i].base_failed]
            d = brute_distances(np.array([[stats[i][c] for c in names] for i in ids], float))
            assert np.allclose(d, [got[i].distance for i in ids], rtol=1e-6)
    assert all(not got[i].kept for i in range(0, 900, 25)) and all(not got[i].kept for i in range(1, 900, 25))
    clean = [got[i].kept for i in range(900) if i % 25 > 1]
    assert np.mean(clean) > 0.995


def test_groups_of_any_size_have_estimates_and_empty_tables(spark, monkeypatch):
    rows = [(i, t, lang, f"s{i % 40}") for i, t, lang, _ in corpus(random.Random(11), 300)]
    first = sorted(map(str, outliers.judge(frame(spark, rows)).collect()))
    assert sum("distance=None" in r for r in first) == sum("base_failed=True" in r for r in first)
    monkeypatch.setattr(outliers, "BROADCAST_GROUPS", 0)
    assert sorted(map(str, outliers.judge(frame(spark, rows)).collect())) == first
    alone = outliers.judge(frame(spark, [(k, t, f"l{k}", None) for k, (_, t, *_) in enumerate(rows[2:8])])).collect()
    assert all(r.kept and r.distance == 0 for r in alone)
    assert outliers.judge(frame(spark, [])).count() == 0
    clash = frame(spark, [(1, "one two three four five six seven eight nine ten", "en", "s")] * 2).withColumn("g", F.lit(1)).withColumn("id", F.lit("x")).withColumn("start", F.lit(0)).withColumn("n", F.lit(0))
    assert [r.kept for r in outliers.judge(clash).collect()] == [True, True]


def test_steps_end_when_nothing_moves(spark, monkeypatch):
    made = []
    keep = outliers.materialize
    monkeypatch.setattr(outliers, "materialize", lambda df, label: (made.append(label), keep(df, label))[1])
    docs = frame(spark, [(i, "one two three four five six seven eight nine ten", "en", "s") for i in range(30)])
    assert all(r.kept for r in outliers.judge(docs).collect())
    assert made.count("estimates") == 4  # all rows, both starts, a step that settles at once and one that shows it


def test_chi_square_quantiles():
    # fixed values from tables of the distribution
    assert abs(outliers.chi_square_quantile(0.95, 5) - 11.0705) < 1e-3
    assert abs(outliers.chi_square_quantile(0.75, 5) - 6.62568) < 1e-4

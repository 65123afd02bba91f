import math
import random

import numpy as np
from util import frame

from panelweave.llm import langid

VOCAB = {
    "aa": "der die das und nicht eine mit sich auch werden schön".split(),
    "bb": "the and of that with from this have been which".split(),
    "cc": "los las que para con una más como pero señor".split(),
}


def rows(rng, n):
    out = []
    for i in range(n):
        lang = rng.choice(list(VOCAB))
        out.append((i, " ".join(rng.choices(VOCAB[lang], k=rng.randint(3, 60))), lang, "s"))
    return out


def test_held_out_accuracy_and_edge_cases(spark):
    rng = random.Random(1)
    data = rows(rng, 400) + [(1000, None, "aa", None), (1001, "", None, "s"), (1002, "123 ... !!", "bb", "s"), (None, "the and of that with", None, None), (5, "the and", "bb", "s")]
    docs = frame(spark, data)
    model = langid.fit(docs.where(~langid.is_held_out()))
    assert model.langs == ["aa", "bb", "cc"] and np.allclose(model.p.sum(axis=0), 1, atol=1e-3)
    got = langid.identify(docs, model).collect()
    assert len(got) == len(data)
    by_id = {r.doc_id: r for r in got}
    held = {r.doc_id for r in docs.where(langid.is_held_out()).collect()}
    right = [by_id[i].lang_pred == lang for i, t, lang, *_ in data if i in held and t and any(map(str.isalpha, t))]
    assert len(right) > 50 and np.mean(right) >= 0.98
    for i in (1000, 1001, 1002):
        assert (by_id[i].lang_pred, by_id[i].score, by_id[i].languages) == ("und", 0.0, [])
    assert by_id[None].lang_pred == "bb" and all(0 <= r.score <= 1 for r in got)


def test_mixture_shares(spark):
    rng = random.Random(2)
    model = langid.fit(frame(spark, rows(rng, 300)))
    half = " ".join(rng.choices(VOCAB["aa"], k=300)) + " " + " ".join(rng.choices(VOCAB["bb"], k=300))
    pure = " ".join(rng.choices(VOCAB["cc"], k=300))
    shares = langid.infer(model, [half, pure, pure + " " + "x" * 100_000])
    assert shares.shape == (3, 3) and np.allclose(shares.sum(axis=1), 1, atol=1e-4)
    assert 0.3 < shares[0, 0] < 0.7 and 0.3 < shares[0, 1] < 0.7 and shares[0, 2] < 0.02
    assert shares[1, 2] > 0.98 and (shares[1] > 0).sum() == 1
    assert np.allclose(langid.infer(model, [pure])[0], shares[1], atol=1e-5)


def test_filter_keeps_columns_and_fills_languages(spark):
    docs = frame(spark, rows(random.Random(3), 200) + [(900, "the and of that with from", None, "s"), (901, "?!", "aa", "s"), (902, None, None, None)])
    kept = langid.keep_identified(docs, langid.fit(docs))
    assert kept.columns == docs.columns
    got = {r.doc_id: r.lang for r in kept.collect()}
    assert got[900] == "bb" and 901 not in got and 902 not in got and len(got) == 201


def test_empty_tables_and_no_labels(spark):
    none = langid.fit(frame(spark, []))
    assert none.langs == [] and langid.identify(frame(spark, []), none).count() == 0
    only = langid.identify(frame(spark, [(1, "words here")]), none).first()
    assert (only.lang_pred, only.score) == ("und", 0.0)
    one = langid.fit(frame(spark, [(1, "words here", "zz", "s")]))
    assert langid.identify(frame(spark, [(1, "words")]), one).first().lang_pred == "zz"
    assert frame(spark, [(None, "a")]).select(langid.is_held_out()).first()[0] is None


def test_rare_languages_are_learned_at_every_size(spark):
    rows = [(k, f"the common words number {k}", "aa", "s") for k in range(6000)] + [(-k, f"zyx wvu qrs {k}", "zz", "s") for k in range(1, 21)]
    model = langid.fit(frame(spark, rows), max_train=60)
    assert model.langs == ["aa", "zz"]
    rare = langid.fit(frame(spark, [r for r in rows if r[2] == "zz"]), max_train=60)
    assert np.array_equal(model.p[:, 1], rare.p[:, 0])  # all of its rows


def brute_mixture(model, text):
    """Expectation-maximisation in plain loops over every nested set of languages, for one text."""
    counts = {}
    raw = (" " + text.lower() + " ").encode()
    for k in range(len(raw) - 2):
        gram = raw[k] | raw[k + 1] << 8 | raw[k + 2] << 16
        bucket = gram * 0x9E3779B1 % 2**32 >> 32 - langid.BUCKETS.bit_length() + 1
        counts[bucket] = counts.get(bucket, 0) + 1
    grams = [(model.p[b].astype(float), n / langid.OVERLAP) for b, n in counts.items()]
    total, k = sum(n for _, n in grams), len(model.langs)

    def em(allowed):
        share = [1 / len(allowed) if j in allowed else 0.0 for j in range(k)]
        for _ in range(langid.STEPS):
            new = [0.0] * k
            for p, n in grams:
                whole = sum(p[j] * share[j] for j in range(k))
                for j in allowed:
                    new[j] += n * p[j] * share[j] / whole
            share = [v / total for v in new]
        return share, sum(n * math.log(sum(p[j] * share[j] for j in range(k))) for p, n in grams)

    full, _ = em(range(k))
    order = sorted(range(k), key=lambda j: -full[j])
    alone = [sum(n * math.log(p[j]) for p, n in grams) for j in range(k)]
    best = max(range(k), key=lambda j: alone[j])
    found, value = [1.0 * (j == best) for j in range(k)], alone[best]
    for size in range(2, k + 1):
        share, likely = em(order[:size])
        if likely - (size - 1) * math.log(max(total, 2)) / 2 > value:
            found, value = share, likely - (size - 1) * math.log(max(total, 2)) / 2
    return found


def test_shares_equal_plain_expectation_maximisation(spark):
    rng = random.Random(7)
    model = langid.fit(frame(spark, rows(rng, 300)))
    texts = [" ".join(" ".join(rng.choices(VOCAB[lang], k=rng.randint(1, 25))) for lang in rng.sample(list(VOCAB), rng.randint(1, 3))) for _ in range(60)] + ["x", "é", "the"]
    got = langid.infer(model, texts)
    for text, share in zip(texts, got, strict=True):
        assert np.allclose(share, brute_mixture(model, text), atol=2e-3), text


def test_ties_go_to_the_first_language_by_name(spark):
    docs = frame(spark, [(k, "one and the same text", lang, "s") for k, lang in enumerate(["zz", "aa", "mm"])])
    got = langid.identify(docs.withColumn("score", docs.doc_id).withColumn("languages", docs.lang).withColumn("id", docs.lang), langid.fit(docs)).collect()
    assert {r.lang_pred for r in got} == {"aa"} and all(r.score == 1.0 for r in got)

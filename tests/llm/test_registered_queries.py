"""Every registered query without SQL, over the whole smallest tables, against brute force on the same rows."""

import hashlib

import numpy as np
import pytest
import test_bpe
import test_langid
import test_outliers
import test_simhash
import test_suffix_dedup
import test_url_ordinal

from panelweave.llm import langid, ordinal, queries
from panelweave.sources.tables import table


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").collect()


def result(spark, sf_dir, name, *columns):
    found = queries.QUERIES[name](spark, sf_dir)
    return sorted(map(tuple, found.select(*columns).collect()), key=str)


def test_op1(spark, sf_dir, docs):
    want = []
    for r in docs:
        s = test_outliers.brute_statistics(r.text)
        want.append((r.doc_id, *s, s[0] < 10 or 100 * s[4] > 20 * s[0]))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = result(spark, sf_dir, "op1_mcd_outliers", *columns, "kept")
    assert [r[:7] for r in got] == sorted(want, key=str) and not any(r[6] and r[7] for r in got)


def test_op2(spark, sf_dir, docs):
    given = table(spark, sf_dir, "documents")
    model = langid.fit(given.where(~langid.is_held_out()))
    got = {r[0]: r for r in result(spark, sf_dir, "op2_language_mixture", "doc_id", "lang_pred", "score")}
    assert len(got) == len(docs)
    for r in docs[::5]:
        if not r.text or not any(map(str.isalpha, r.text)):
            assert got[r.doc_id][1:] == ("und", 0.0)
            continue
        share = test_langid.brute_mixture(model, r.text)
        assert got[r.doc_id][1] == model.langs[int(np.argmax(share))] and abs(got[r.doc_id][2] - max(share)) < 5e-3


def test_op4(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url").collect()
    got = result(spark, sf_dir, "op4_url_filter", "page_id", "host", "path", "rule", "verdict", "score")
    want = {r.page_id: (*test_url_ordinal.brute_parts(r.url), *test_url_ordinal.brute_rule(*test_url_ordinal.brute_parts(r.url))) for r in pages}
    assert len(got) == len(pages)
    for page, host, path, rule, verdict, score in got:
        assert want[page] == (host, path, rule, verdict if rule else None)
        assert rule or verdict == ("block" if score >= 0.5 else "allow")


def test_op6(spark, sf_dir, docs):
    labels = {r.doc_id: 0 if r.toxic else 2 if r.quality else 1 for r in table(spark, sf_dir, "labels").collect()}
    got = result(spark, sf_dir, "op6_ordinal_quality", "doc_id", "expected_grade", "tail_prob", "kept")
    assert len(got) == len(docs) and all(k == (t >= 0.5) and 0 <= e <= 2 for _, e, t, k in got)
    grades = {i: e for i, e, *_ in got}
    low, high = ([grades[i] for i, g in labels.items() if g in which and i in grades] for which in ((0, 1), (2,)))
    assert np.mean(low) < np.mean(high)


def test_op7(spark, sf_dir, docs):
    assert result(spark, sf_dir, "op7_simhash_near_dedup", "doc_id", "fingerprint", "component_id") == test_simhash.brute([(r.doc_id, r.text) for r in docs])


def test_op9(spark, sf_dir, docs):
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert result(spark, sf_dir, "op9_suffix_dedup", *columns) == test_suffix_dedup.brute([(r.doc_id, r.text) for r in docs])


def test_op10(spark, sf_dir, docs):
    want = []
    for r in docs:
        ids = test_bpe.OWN.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert result(spark, sf_dir, "op10_byte_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)


def test_a_grade_model_is_bounded_by_its_parameter(spark, sf_dir):
    ratings = table(spark, sf_dir, "labels").selectExpr("doc_id", "quality AS grade")
    few = ordinal.fit(table(spark, sf_dir, "documents"), ratings, max_train=40)
    assert len(few.thresholds) == 1 and np.isfinite(few.weights).all()

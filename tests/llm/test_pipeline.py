import hashlib
from collections import Counter

import corpus_pipeline as cp
import public_tokenizers as P
import tiktoken
from test_exact_line_mixing import brute_lines
from test_jaccard import brute_firsts
from util import frame

from panelweave.llm import bpe, langid, mixing
from panelweave.sources.tables import table


def test_stages_equal_brute_force_on_the_smallest_tables(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    given = docs.collect()
    model = langid.fit(docs)
    first = cp.language_id(spark, docs, sf_dir)
    assert first.columns == columns
    lettered = [r for r in given if r.text and any(map(str.isalpha, r.text))]
    shares = langid.infer(model, [r.text for r in lettered]).max(axis=1)
    assert {r.doc_id for r in first.collect()} == {r.doc_id for r, s in zip(lettered, shares, strict=True) if s >= 0.4}
    assert first.count() >= 0.97 * len(given)

    second = cp.drop_lines(spark, first, sf_dir)
    assert second.columns == columns
    got = second.collect()
    want = {i: t for i, _, _, t in brute_lines([(r.doc_id, r.text) for r in first.collect()])}
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)

    third = cp.near_dedup(spark, second, sf_dir)
    assert third.columns == columns
    assert Counter(r.doc_id for r in third.collect()) == brute_firsts([(r.doc_id, r.text) for r in got])

    fourth = cp.mix_sources(spark, third, sf_dir)
    assert fourth.columns == columns
    copies = Counter(r.doc_id for r in mixing.replicate(third).collect())
    assert Counter(r.doc_id for r in fourth.collect()) == copies

    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    by_id = {r.doc_id: r.text for r in fourth.collect()}
    last = cp.STAGES[-1][1](spark, fourth, sf_dir).collect()
    assert Counter(r.doc_id for r in last) == copies
    for r in last:
        assert r.token_ids == own.encode_ordinary(by_id[r.doc_id]) and r.n_tokens == len(r.token_ids)
        assert r.decoded_sha256 == hashlib.sha256(by_id[r.doc_id].encode()).hexdigest()

    ran = cp.run(spark, sf_dir).collect()
    assert Counter((r.doc_id, r.decoded_sha256) for r in ran) == Counter((r.doc_id, r.decoded_sha256) for r in last)


def test_stages_take_odd_rows_and_empty_tables(spark, sf_dir):
    for rows in ([], [(1, None), (2, ""), (2, ""), (None, "one two three four"), (3, "one two three four", None, None), (4, "!!", "en", "s")]):
        docs = frame(spark, rows)
        for _, stage in cp.STAGES:
            docs = stage(spark, docs, sf_dir)
        docs.count()
    assert [name for name, _ in cp.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "poisson_mixing", "byte_bpe"]

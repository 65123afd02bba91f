import bisect
import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from util import frame

from panelweave.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
OWN_A = tokenizers.Tokenizer.from_file(A)
OWN_A.encode_special_tokens = True
OWN_B = sentencepiece.SentencePieceProcessor(model_file=B)
TOKEN = {i: t for t, i in OWN_A.get_vocab().items()}

TEXTS = [
    "héllo 你好 😀x y \x00 <s> </s> \n\n  z <0x41> 𓀀𓀁 ꙮ ﷽ <|endoftext|>a",
    "x▁y",  # reads as a space: B does not keep it
    "fine words and x▁y between them",
    None,
    "",
    "a",
    " ",
    "  \n\n\t  ",
    "日本語テキスト🎉🎉 naïve naïve naïve",
    "ﬁ Ⅷ Å ́e it's we'll 3.14 ...!?  two  spaces",
    "\r\n a b 　end",
    "word " * 3000,
    "unbroken" * 2000,
    "the same words and the same words",
    "the same words and the same words",
]


def spans(pieces):
    out, at = [], 0
    for p in pieces:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def brute_tokens(text):
    if not text:
        return None
    ids_a, ids_b = OWN_A.encode(" " + text, add_special_tokens=False).ids, OWN_B.encode(text)
    symbols = alignment.byte_of_symbol()
    bytes_a = [bytes(symbols[c] for c in TOKEN[i]) for i in ids_a]
    names = map(OWN_B.id_to_piece, ids_b)
    bytes_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in names]
    data = (" " + text).encode()
    return (ids_a, spans(bytes_a), ids_b, spans(bytes_b)) if b"".join(bytes_a) == b"".join(bytes_b) == data else None


def brute(texts):
    """The rows (n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of texts, by overlapping every token with every other."""
    found, links = [brute_tokens(t) for t in texts], []
    for x in found:
        own, start = [], 0
        for a, (p, q) in zip(x[0], x[1], strict=True) if x else ():
            while x[3][start][1] <= p:
                start += 1
            j = start
            while j < len(x[3]) and x[3][j][0] < q:
                own.append((a, x[2][j]))
                j += 1
        links.append(own)
    count, top = Counter(link for own in links for link in own), defaultdict(int)
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    rows = []
    for x, own in zip(found, links, strict=True):
        if not x:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        shared = sorted({q for _, q in x[1]} & {q for _, q in x[3]})
        sides = [defaultdict(list), defaultdict(list)]
        for side, ids, where in ((0, x[0], x[1]), (1, x[2], x[3])):
            for i, (_, q) in zip(ids, where, strict=True):
                sides[side][bisect.bisect_left(shared, q)].append(str(i))
        groups = ";".join(",".join(sides[0][k]) + "|" + ",".join(sides[1][k]) for k in range(len(shared)))
        rows.append((len(x[0]), len(x[2]), len(shared), len(own), sum(count[k] == top[k[1]] for k in own), sum(count[k] for k in own), groups))
    return rows


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def test_equals_brute_force_on_odd_texts(spark):
    got = alignment.align(frame(spark, list(enumerate(TEXTS))).repartition(3), A, B).orderBy("doc_id").select(*COLUMNS)
    want = brute(TEXTS)
    assert [tuple(r) for r in got.collect()] == want
    assert [want[k][0] for k in (1, 2, 3, 4)] == [0, 0, 0, 0] and all(r[3] == r[0] + r[1] - r[2] for r in want)


def test_repeated_and_null_ids_extra_columns_and_an_empty_table(spark):
    rows = [(7, "one two"), (7, "one two"), (None, "three"), (None, None)]
    docs = frame(spark, rows).selectExpr("doc_id", "text", "'x' AS id", "'y' AS chunk", "1 AS pairs", "2 AS count")
    got = sorted((tuple(r) for r in alignment.align(docs, A, B).select("doc_id", *COLUMNS).collect()), key=str)
    assert got == sorted([(i, *w) for (i, _), w in zip(rows, brute([t for _, t in rows]), strict=True)], key=str)
    assert alignment.align(docs.limit(0), A, B).count() == 0


@pytest.fixture(scope="module")
def aligner():
    with open(A) as a, open(B, "rb") as b:
        return alignment.Aligner(a.read(), b.read())


PIECES = st.sampled_from(["a", "the", "ing", " ", " ", "  ", "\n", "é", "你", "😀", "𓀀", "▁", "'s", "9", "<s>", "<|endoftext|>", "\x00", " ", "́", " ", "Ω"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=12).map("".join), max_size=6))
def test_words_by_themselves_give_what_whole_texts_give(aligner, texts):
    assert aligner.cuts
    rows = aligner.align(texts)
    for text, *got in zip(texts, *(rows[c] for c in ("n_a", "n_b", "n_groups", "n_links", "groups", "places", "times")), strict=True):
        x = brute(([text]))[0]
        assert (*map(int, got[:4]), got[4]) == (*x[:4], x[6])
        assert int(got[6].sum()) == x[3] and len(set(got[5].tolist())) == len(got[5])
    assert rows["totals"].sum() == sum(rows["n_links"])


def test_without_a_promise_of_the_vocabulary_texts_stay_whole(aligner):
    texts = [t or "" for t in TEXTS]
    cut = aligner.align(texts)
    aligner.cuts = False
    try:
        assert aligner.words("a b") == ["a b"]
        whole = aligner.align(texts)
    finally:
        aligner.cuts = True
    assert all(np.array_equal(np.concatenate(cut[c]) if c == "times" else cut[c], np.concatenate(whole[c]) if c == "times" else whole[c]) for c in ("n_a", "n_b", "n_groups", "n_links", "groups", "times"))


def test_pieces_of_a_line_are_read_once(aligner):
    read = []

    class Pieces(list):
        def __iter__(self):
            read.append(1)
            return super().__iter__()

    class Proto:
        def __init__(self, proto):
            self.pieces = Pieces(proto.pieces)

    class Encoder:
        def encode(self, texts, **how):
            return [Proto(x) for x in aligner.b.encode(texts, **how)]

    own = alignment.Aligner.__new__(alignment.Aligner)
    own.__dict__.update(aligner.__dict__, b=Encoder())
    texts = ["plain words", "naïve 😀 text"]
    assert own.align(texts)["groups"] == aligner.align(texts)["groups"]
    lines = len(aligner._lines(list(dict.fromkeys(w for t in texts for w in aligner.words(t)))))
    assert len(read) == lines


def test_parts_of_characters_are_placed_by_decoded_bytes():
    # a character of four bytes in three tokens, whose spans are all of it, between two plain tokens
    begin, end, sizes = np.array([0, 2, 2, 2, 6]), np.array([2, 6, 6, 6, 9]), np.array([2, 1, 2, 1, 3])
    assert alignment.refine(begin, end, sizes).tolist() == [2, 3, 5, 6, 9]


def test_the_query_over_its_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = [(r.doc_id, *w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "") for r, w in zip(docs, brute([r.text for r in docs]), strict=True)]
    got = queries.QUERIES["op11_token_alignment"](spark, sf_dir).select("doc_id", *COLUMNS[:6], "groups_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)

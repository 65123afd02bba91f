import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from util import frame

from panelweave.llm import bpe

RANKS = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
OWN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.mark.parametrize("leaf", [2, 4, 24])
def test_tree_equals_the_library_on_single_pieces(leaf):
    tree, rng = bpe.TreeBPE(RANKS, leaf), random.Random(leaf)
    alphabets = ["ab", "the in", "aaaaaaab", "éàü ñ", "0123456789", "=-*#", "\x00\xff漢字"]
    for k in range(600):
        piece = "".join(rng.choices(alphabets[k % len(alphabets)], k=rng.randint(1, 150))).encode()
        assert tree.encode(piece) == OWN._core_bpe.encode_single_piece(piece)
    for piece in (b"a" * 3001, b" " * 2500, b"ab" * 1500 + b"c", b"=" * 1023):
        assert tree.encode(piece) == OWN._core_bpe.encode_single_piece(piece)
        assert tree.decode(tree.encode(piece)) == piece


def test_query_rows_equal_the_library(spark):
    rng = random.Random(1)
    texts = [None, "", " ", "a", "  <|endoftext|> it's\n\n\tl'été 漢字 123", "x" * 5000, " \n" * 700, "word " * 20000]
    texts += ["".join(rng.choices("abc déf  \n\t'.,1", k=rng.randint(1, 400))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "a"), (None, "null id")]
    got = sorted(map(tuple, bpe.encode_and_decode(frame(spark, rows), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()), key=str)
    want = []
    for i, t in rows:
        ids = OWN.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_decoding_by_itself(spark):
    tokens = spark.createDataFrame([(1, OWN.encode_ordinary("l'été 漢字 x" * 900)), (2, []), (3, None)], "doc_id long, token_ids array<int>")
    got = {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(tokens, P.path("byte_bpe_50k.tiktoken")).collect()}
    assert got == {1: "l'été 漢字 x" * 900, 2: "", 3: ""}


def test_empty_table_extra_columns_and_clashing_names(spark):
    docs = frame(spark, [])
    assert bpe.encode_and_decode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    clash = bpe.encode(frame(spark, [(1, "a")]).withColumnRenamed("lang", "token_ids"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert clash.first().token_ids == OWN.encode_ordinary("a") and sorted(clash.columns) == ["doc_id", "n_chars", "source", "text", "token_ids"]

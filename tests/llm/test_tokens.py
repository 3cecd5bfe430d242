"""BPE encoding and ORC output against the tokenizer libraries."""

import base64
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from margrave.llm import bpe, token_orc
from margrave.llm.common import scratch_path
from margrave.llm.textops import utf8
from tests.llm.common import SCHEMA, awkward, rows, sample

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
ODD = [
    "I'll don't  we've 'sok ''s  's\n's x's", "", "a", "  ", "a  b\n\nc \n d\t\te ", "été's l'été 12³ ½ x²  y", "日本語 テキスト 123", "<|endoftext|> hi", "\x85 \x1c a", "   lead", "trail   ", "'", "a'", "😀😀 's", " 'tis",
]


@pytest.fixture(scope="module")
def enc():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def mess(rng, n):
    return "".join(rng.choice(["a", "bc", " ", "  ", "\n", "'s", "'", "9", "é", "日", "!", " the", "\t", "x" * 40]) for _ in range(n))


def test_bpe_round_trip_awkward(spark, enc):
    docs = spark.createDataFrame(awkward() + rows(ODD, 100), SCHEMA)
    out = bpe.bpe_decode(bpe.bpe_encode(docs, RANKS, P.PATTERN), RANKS).collect()
    assert len(out) == len(awkward()) + len(ODD)
    want = sorted((r[1] or "").encode() for r in awkward() + rows(ODD, 100))
    assert sorted(bytes(r.decoded) for r in out) == want
    assert all(r.ids == enc.encode_ordinary(bytes(r.decoded).decode()) for r in out)
    fused = bpe.bpe_encode(docs, RANKS, P.PATTERN, decoded=True).collect()
    assert sorted((r.ids, bytes(r.decoded)) for r in fused) == sorted((r.ids, bytes(r.decoded)) for r in out)
    assert bpe.bpe_encode(spark.createDataFrame([], SCHEMA), RANKS, P.PATTERN).count() == 0


def test_chunks_stitch_to_the_same_ids(spark, enc):
    rng = random.Random(4)
    texts = [mess(rng, 300) for _ in range(30)] + ["z" * 500, " " * 500, "ab " * 300]
    out = bpe.bpe_encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), RANKS, P.PATTERN, chunk=64, overlap=16).collect()
    assert {r.doc_id: r.ids for r in out} == {i: enc.encode_ordinary(t) for i, t in enumerate(texts)}


def test_no_shared_boundary_leaves_one_piece():
    assert bpe.cuts([(0, [], [70]), (1, [71], []), (2, [130], [])]) == [0]
    assert bpe.cuts([(0, [], [66, 70]), (1, [70], [130]), (2, [130], [])]) == [0, 70, 130]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_pieces_follow_the_library(tokenizer):
    own, rng = token_orc.PieceEncoder(open(P.path("byte_bpe_50k.json")).read()), random.Random(2)
    for texts in ([t] for t in ODD):
        ids, n = own(*utf8(pa.array(texts)))
        assert ids.tolist() == tokenizer.encode(texts[0], add_special_tokens=False).ids
    texts = [mess(rng, 60) for _ in range(200)] + sample(2)
    ids, n = own(*utf8(pa.array(texts)))
    at = np.concatenate([[0], np.cumsum(n)])
    assert [ids[i:j].tolist() for i, j in zip(at, at[1:])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_orc_files(spark, tokenizer):
    path = scratch_path(spark, "test-tokens")
    docs = awkward() + rows(ODD, 100)
    token_orc.write_token_orc(spark.createDataFrame(docs, SCHEMA), P.path("byte_bpe_50k.json"), path)
    index = token_orc.token_index(spark, path).collect()
    assert len(index) == len(docs)
    at = 0
    for r in sorted(index, key=lambda r: (r.start, r.n_tokens)):
        assert r.start == at
        at += r.n_tokens
    ids = sorted((r.doc_id for r in index), key=lambda x: -1 if x is None else x)
    assert [r.doc_id for r in sorted(index, key=lambda r: r.start)] == ids
    for doc_id, text, *_ in docs:
        if doc_id is not None and doc_id >= 100:
            want = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
            r = next(r for r in index if r.doc_id == doc_id)
            assert (r.n_tokens, r.ids_crc32) == (len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
            assert token_orc.read_token_orc(spark, path, [doc_id]).first().ids == want
    plan = token_orc.read_token_orc(spark, path, [101])._jdf.queryExecution().toString()
    assert "PushedFilters: [In(doc_id" in plan or "EqualTo(doc_id" in plan
    empty = scratch_path(spark, "test-tokens")
    token_orc.write_token_orc(spark.createDataFrame([], SCHEMA), P.path("byte_bpe_50k.json"), empty)
    assert token_orc.token_index(spark, empty).count() == 0

"""The pipeline's stages and the registered queries against plain versions."""

import base64
import hashlib
import os
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest

import corpus_pipeline
from margrave.llm import pseudo_likelihood
from margrave.llm.quality_knn import fit_quality
from margrave.llm.queries import ORACLES, QUERIES
from tests.llm.common import awkward
from tests.llm.test_dedup import plain_components, plain_lines, plain_substrings
from tests.llm.test_search import plain_base, plain_hits, plain_sums, plain_votes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    return c


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    cols = sorted(df.columns)
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == cols
    assert sorted(map(str, (tuple(r) for r in df.select(cols).collect()))) == sorted(map(str, want.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall()))


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_substrings_against_a_plain_version(spark, small, texts):
    want = {d: (n, g, sha(t)) for d, (n, g, t) in plain_substrings(list(texts.items()), 13).items()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op2_substring_dedup"](spark, small).collect()} == want


def test_secrets_against_a_plain_version(spark, small, texts):
    kinds = ("assign", "access", "hex")
    for r in QUERIES["op3_secret_scan"](spark, small).collect():
        base = plain_base(texts[r.doc_id] or "")
        written = [f"{kinds[k]}:{i}:{j}" for i, k, j in base]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == n for _, k, _ in base) for n in range(3)]
        assert r.base_sha256 == sha(",".join(written)) and set(written) <= set(r.spans.split(",")) | {""}


def test_token_files_against_the_library(spark, small, texts):
    from tokenizers import Tokenizer

    tk, at = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op4_token_orc"](spark, small).collect()}
    for d in sorted(texts):
        ids = tk.encode(texts[d] or "", add_special_tokens=False).ids + [0]
        assert got.pop(d) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert not got


def test_bpe_against_the_library(spark, small, texts):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in QUERIES["op8_byte_level_bpe"](spark, small).collect():
        ids = enc.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(texts[r.doc_id] or ""))


def test_neighbours_against_brute_force(spark, small, duck):
    ids, vecs = zip(*duck.sql("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall(), strict=True)
    x, hit, n = np.array(vecs, float), 0, 0
    got = {}
    for r in QUERIES["op6_cross_polytope"](spark, small).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {i for i in ids if i % 20 == 0}
    for q, found in got.items():
        s = x @ x[ids.index(q)]
        s[ids.index(q)] = -np.inf
        best = {ids[j] for j in np.lexsort((ids, -s))[:20]}
        assert [r for r, *_ in sorted(found)] == list(range(1, 21))
        assert all(abs(v - s[ids.index(i)]) < 1e-9 for _, i, v in found)
        hit, n = hit + len(best & {i for _, i, _ in found}), n + 20
    assert hit >= 0.9 * n


def test_quality_and_scores(spark, small, texts, duck):
    rows = QUERIES["op7_quality_knn"](spark, small).collect()
    assert {r.doc_id for r in rows} == set(texts) and all(r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    want = plain_votes(fit_quality(docs, labels), texts)
    assert all(r.score == pytest.approx(want[r.doc_id], abs=1e-3) for r in rows)
    lm = QUERIES["op1_pseudo_likelihood"](spark, small).collect()
    assert len(lm) == len(texts) and all(r.log_likelihood <= 0 and r.n_tokens == len((texts[r.doc_id] or "").encode().split()) for r in lm)
    sums = plain_sums(pseudo_likelihood.train(docs), texts)
    assert all((r.n_tokens, r.log_likelihood) == (sums[r.doc_id][0], pytest.approx(sums[r.doc_id][1], abs=1e-3 * max(1, r.n_tokens))) for r in lm)


def same(df, want):
    got = {r.doc_id: r.text for r in df.collect()}
    assert got == want


def test_stages_against_plain_versions(spark, small, duck):
    """Every stage on what the stage before kept."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "line_dedup", "near_dedup", "decontaminate", "bpe"]
    kept = stages["quality"](spark, docs, small)
    assert kept.columns == docs.columns
    scores = {r.doc_id: r.score for r in QUERIES["op7_quality_knn"](spark, small).collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if scores[r.doc_id] >= 0.7}
    same(kept, texts)
    lines = plain_lines(list(texts.items()), corpus_pipeline.MIN_LINES)
    texts = {d: t for d, (t, n, gone) in lines.items() if not gone or gone < n}
    kept = stages["line_dedup"](spark, kept, small).cache()
    assert kept.columns == docs.columns and kept.where("n_chars <> length(text)").isEmpty()
    same(kept, texts)
    groups = plain_components(list(texts.items()), corpus_pipeline.SHINGLE, corpus_pipeline.PERCENT)
    texts = {d: t for d, t in texts.items() if groups[d][1] == d}
    kept = stages["near_dedup"](spark, kept, small).cache()
    assert kept.columns == docs.columns
    same(kept, texts)
    items = duck.sql("SELECT item_id, text FROM benchmark").fetchall()
    hits = {d: n for d, _, n, _ in plain_hits(list(texts.items()), items, corpus_pipeline.WINDOW)}
    texts = {d: t for d, t in texts.items() if not hits[d]}
    kept = stages["decontaminate"](spark, kept, small).cache()
    assert kept.columns == docs.columns
    same(kept, texts)
    out = {r.doc_id: (r.n_tokens, len(r.ids), r.decoded_sha256) for r in stages["bpe"](spark, kept, small).collect()}
    assert {d: h for d, (*_, h) in out.items()} == {d: sha(t) for d, t in texts.items()} and all(a == b for a, b, _ in out.values())
    assert {r.doc_id for r in corpus_pipeline.run(spark, small).collect()} == set(texts)


def test_stages_awkward(spark, small):
    rows = [(d, t, lang, k, 3) for d, t, lang, _, k, *_ in awkward()]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as g", "2 as `key`", "'z' as n_lines")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small).cache()
        assert out.count() > 0 and stage(spark, docs.limit(0), small).count() == 0
        if name != "bpe":
            assert out.columns == docs.columns
            docs = out

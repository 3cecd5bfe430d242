"""Substring dedup, line dedup and the n-gram join against plain versions."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from margrave.llm import fingerprints, line_dedup, ngram_join, substring_dedup, textops
from tests.llm.common import SCHEMA, awkward, rows, sample

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def plain_substrings(docs, k):
    first = {}
    for d, t in docs:
        for i in range(len(words(t)) - k + 1):
            s = tuple(words(t)[i : i + k])
            first[s] = min(first.get(s, d), d)
    out = {}
    for d, t in docs:
        w, gone = words(t), set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < d:
                gone |= set(range(i, i + k))
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


@pytest.mark.parametrize("k", [3, 13])
def test_substring_dedup(spark, k):
    texts = sample(k, words=60)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.substring_dedup(spark.createDataFrame(rows(texts), SCHEMA), k).collect()}
    assert got == plain_substrings(list(enumerate(texts)), k)


def test_substring_intervals(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "x a b c d y a b c"), (3, "q")], "doc_id long, text string")
    got = {r.doc_id: r.removed for r in substring_dedup.substring_dedup(docs, 3).collect()}
    assert got == {1: [], 2: [[1, 5], [6, 9]], 3: []}


def test_substring_dedup_awkward(spark):
    out = substring_dedup.substring_dedup(spark.createDataFrame(awkward(), SCHEMA), 13).collect()
    assert len(out) == len(awkward())
    by_id = {}
    for r in out:
        by_id.setdefault(r.doc_id, []).append(r)
    assert by_id[0][0].n_words == 0 and by_id[0][0].kept_text == ""
    assert by_id[6][0].n_removed == 30_000 and by_id[5][0].n_removed == 0  # the long text's copy
    assert by_id[8][0].n_removed == 16 and by_id[7][0].n_removed == 0
    assert all(r.n_removed == 0 for r in by_id[None])
    assert substring_dedup.substring_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def plain_lines(docs, m):
    first, seqs = {}, {d: [x for x in (t or "").split("\n") if x.strip()] for d, t in docs}
    for d, s in sorted(seqs.items()):
        for i in range(len(s) - m + 1):
            first.setdefault(tuple(s[i : i + m]), (d, i))
    out = {}
    for d, t in docs:
        s, gone, kept, n = seqs[d], set(), [], -1
        for i in range(len(s) - m + 1):
            if first[tuple(s[i : i + m])] < (d, i):
                gone |= set(range(i, i + m))
        for x in (t or "").split("\n"):
            if x.strip():
                n += 1
                if n in gone:
                    continue
            kept.append(x)
        out[d] = (None if t is None else "\n".join(kept), len(s), len(gone))
    return out


@pytest.mark.parametrize("m", [1, 2, 3, 5])
def test_line_dedup(spark, m):
    rng = random.Random(m)
    texts = ["\n".join(rng.choice("abcd") if rng.random() < 0.9 else " " for _ in range(rng.randint(0, 14))) for _ in range(14)]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.line_dedup(spark.createDataFrame(rows(texts), SCHEMA), m).collect()}
    assert got == plain_lines(list(enumerate(texts)), m)


def test_suffix_ranks_are_classes_and_ordered(spark):
    docs = [(1, "abab"), (2, "babx"), (3, "abaq")]
    lines = [(d, d, i, ord(c), 0) for d, s in docs for i, c in enumerate(s)]
    levels, _ = line_dedup.suffix_ranks(spark.createDataFrame(lines, "key long, doc_id long, i int, h1 long, h2 long"), 2)
    text = dict(docs)
    for k, level in enumerate(levels):
        got = [(r.rank, text[r.doc_id][r.i : r.i + (1 << k)]) for r in level.collect()]
        for (ra, a), (rb, b) in itertools.combinations(got, 2):
            assert (ra == rb) == (a == b) and (ra < rb) == (a < b)


def test_runs_are_longest_common_prefixes(spark):
    rng = random.Random(4)
    docs = [(d, "".join(rng.choice("ab") for _ in range(rng.randint(1, 20)))) for d in range(8)] + [(8, "q" * 9), (9, "z" + "pqrstuvwxyz" * 2), (10, "pqrstuvwxyz")]
    text = dict(docs)
    lines = [(d, d, i, ord(c), 0) for d, s in docs for i, c in enumerate(s)]
    runs = line_dedup.repeated_runs(spark.createDataFrame(lines, "key long, doc_id long, i int, h1 long, h2 long"), 2).collect()
    for r in runs:
        a, b = text[r.doc_id][r.i :], text[r.first.doc_id][r.first.i :]
        common = next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert r.length == common >= 2 and (r.first.doc_id, r.first.i) < (r.doc_id, r.i)
        before = min((d, i) for d, s in docs for i in range(len(s)) if s[i : i + 2] == a[:2])
        assert (r.first.doc_id, r.first.i) == before  # the first copy of its beginning
    own = [(r.i, r.length, r.first.doc_id, r.first.i) for r in runs if r.doc_id == 10]
    assert own == [(0, 11, 9, 1)]  # one run, not one for each window of two lines
    assert [(r.i, r.length, r.first.i) for r in runs if r.doc_id == 8] == [(1, 8, 0)]
    wanted = {(d, j) for d, s in docs for i in range(len(s) - 1) for j in (i, i + 1) if min((e, k) for e, t in docs for k in range(len(t)) if t[k : k + 2] == s[i : i + 2]) < (d, i)}
    assert {(r.doc_id, j) for r in runs for j in range(r.i, r.i + r.length)} == wanted


def test_long_single_lines(spark):
    long, short = " ".join(f"w{i}" for i in range(50)), "a short line"
    texts = [f"x\n{long}\ny", f"p\n{long}\nq\n{short}", long, short, f"{long}\n{short}", f"{long} more\nz"]
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.line_dedup(docs, 2, long_words=50).collect()}
    assert got == {0: (texts[0], 0), 1: (f"p\nq\n{short}", 1), 2: ("", 1), 3: (short, 0), 4: (short, 1), 5: (texts[5], 0)}
    assert {r.doc_id: r.n_removed for r in line_dedup.line_dedup(docs, 2).collect()} == dict.fromkeys(range(6), 0)
    three = spark.createDataFrame([(1, f"a\n{long}\nb\nc"), (2, f"{long}\nb\nz"), (3, "a\nb\nc")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in line_dedup.line_dedup(three, 3, long_words=50).collect()} == {1: 0, 2: 1, 3: 0}


def test_line_dedup_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a\nb", 1, 2, 3, 4), (2, "a\nb", 5, 6, 7, 8)], "doc_id int, text string, __key int, key_ int, Doc_ int, runs_ int")
    got = sorted(tuple(r) for r in line_dedup.line_dedup(docs).collect())
    assert got == [(1, "a\nb", 1, 2, 3, 4, 2, 0), (2, "", 5, 6, 7, 8, 2, 2)]


def test_line_dedup_awkward(spark):
    line = [(1, "a\nb"), (2, "a\nb"), (2, "a\nb"), (None, "a\nb"), (3, None), (4, "")]
    out = line_dedup.line_dedup(spark.createDataFrame([(*r, 7, "z") for r in line], "doc_id long, text string, n_lines int, key string")).collect()
    assert sorted((r.doc_id or 0, r.text, r.n_removed, r.key) for r in out if r.text is not None) == [(0, "a\nb", 0, "z"), (1, "a\nb", 0, "z"), (2, "", 2, "z"), (2, "", 2, "z"), (4, "", 0, "z")]
    assert [r.text for r in out if r.doc_id == 3] == [None]
    assert line_dedup.line_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    assert line_dedup.line_dedup(spark.createDataFrame(awkward(), SCHEMA)).count() == len(awkward())


def shingles(text, n):
    w = words((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def plain_components(docs, n, percent):
    sets, root = {d: shingles(t, n) for d, t in docs}, {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_ngram_join(spark, n, percent):
    texts = sample(n, n=120, words=50)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(spark.createDataFrame(rows(texts), SCHEMA), n, percent).collect()}
    assert got == plain_components(list(enumerate(texts)), n, percent)


@pytest.mark.parametrize("seed", [9, 10])
def test_ngram_join_in_blocks(spark, monkeypatch, seed):
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 2000)
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(80)]
    texts = sample(seed, n=60, words=60)
    for _ in range(60):  # near copies, some of them near to other copies only
        copy = list(base if rng.random() < 0.6 else texts[-1].split(" "))
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(50)}"
        texts.append(" ".join(copy))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(spark.createDataFrame(rows(texts), SCHEMA), 4, 85).collect()}
    assert got == plain_components(list(enumerate(texts)), 4, 85)


def test_ngram_join_threshold_is_exact(spark):
    base = [f"w{i}" for i in range(20 + 3)]  # 20 shingles of 4 words
    near = [*base, "x", "y", "z"]  # 3 more: 20 / 23 = 0.869
    far = [*base, "p", "q", "r", "s"]  # 20 / 24 = 0.833
    docs = [(1, " ".join(base)), (2, " ".join(near).upper()), (3, " ".join(far)), (4, "a b"), (5, "a  b"), (6, "a b c")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: (20, 1), 2: (23, 1), 3: (24, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6)}


def test_ngram_join_awkward(spark):
    out = ngram_join.ngram_join(spark.createDataFrame(awkward(), SCHEMA)).collect()
    assert len(out) == len(awkward())
    by_id = {(r.doc_id, r.n_shingles, r.component_id) for r in out}
    assert (6, 700, 5) in by_id and (8, 13, 7) in by_id and (None, 13, None) in by_id and (1, 0, 1) in by_id and (0, 0, 0) in by_id
    assert ngram_join.ngram_join(spark.createDataFrame([], SCHEMA)).count() == 0


def test_words_follow_the_pattern():
    texts = sample(3) + ["  a\x0bb\x0c c\r\n", "", "\x1ca b", "x", "y"]
    data, offsets = textops.utf8(pa.array(texts))
    w = textops.words(data, offsets)
    got = [[] for _ in texts]
    for i, j, d in zip(w.start, w.end, w.doc, strict=True):
        got[d].append(data[i:j].tobytes().decode())
    assert got == [words(t) for t in texts]
    by = {}
    for h, t in zip(w.hash.tolist(), itertools.chain.from_iterable(got), strict=True):
        assert by.setdefault(t, h) == h
    assert len(set(by.values())) == len(by)
    assert textops.join_kept(w, np.ones(len(w.hash), bool)).to_pylist() == [" ".join(words(t)) for t in texts]


def test_packed_hashes_come_back():
    h = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64))
    for part in (h, h[:1], h[:2], h[500:]):
        assert (fingerprints.unpack(fingerprints.pack(part)) == part).all()
    ends = np.array([1, 400, 1000])
    column = fingerprints.plain(h, ends)
    n, values = fingerprints.runs(column, np.array([2, 0, 1]), "<u8", fingerprints.unpack)
    assert n.tolist() == [600, 1, 399] and (values == np.concatenate([h[400:], h[:1], h[1:400]])).all()
    mixed = pa.chunked_array([column, fingerprints.packed([fingerprints.pack(h[:5])])])
    n, values = fingerprints.runs(mixed, np.arange(4), "<u8", fingerprints.unpack)
    assert n.tolist() == [1, 399, 600, 5] and (values == np.concatenate([h, h[:5]])).all()
    bucket = fingerprints.bucket_of(h, 7, 64)
    assert (np.diff(bucket) >= 0).all() and bucket.max() < 7


def test_groups_follow_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "CUTS", 3)
    monkeypatch.setattr(fingerprints, "GROUP_BYTES", 10)
    ids = [*range(0, 1000, 7), *range(10**12, 10**12 + 50), -5, -5, None]
    groups, _ = fingerprints.grouped(spark.createDataFrame([(i, "x" * 30) for i in ids], "doc_id long, text string"), "doc_id", "text")
    got = sorted((r.doc_id, r.g) for r in groups.collect() if r.doc_id is not None)
    assert all(a[1] <= b[1] for a, b in itertools.pairwise(got)) and len({g for _, g in got}) > 20
    assert [r.g for r in groups.where("doc_id is null").collect()] == [-1] and groups.where("doc_id = -5").select("g").distinct().count() == 1


def test_null_ids_and_one_hot_id_are_no_group(spark):
    """A third of the rows has no id and a third one id: no group holds either, and results are as if they were apart."""
    text = " ".join(f"w{i}" for i in range(20))
    ids = [*range(1000), *[None] * 1000, *[500] * 1000]
    docs = spark.createDataFrame([(i, f"{text} x{n % 50}") for n, i in enumerate(ids)], "doc_id long, text string")
    groups, unmet, _ = fingerprints.met_and_unmet(docs, "doc_id", "text")
    assert unmet.count() == 1000
    sizes = [r["count"] for r in groups.groupBy("g").count().collect()]
    assert sum(sizes) == 2000 and max(sizes) < 400
    got = substring_dedup.substring_dedup(docs, 13).collect()
    assert len(got) == 3000
    for r in got:
        # the first 20 words are a copy of document 0's; the last one too from document 50 on
        assert (r.n_removed == 0) if not r.doc_id else (r.n_removed >= 20)
    assert all(r.n_removed == 21 for r in got if r.doc_id == 500)
    own = {(r.doc_id, r.component_id) for r in ngram_join.ngram_join(docs).collect()}
    assert own == {(None, None)} | {(i, 0) for i in range(1000)}


def test_plain_rows_give_the_same(spark, monkeypatch):
    texts = sample(13, words=60)
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    want = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.substring_dedup(docs, 3).collect()}
    assert want == plain_substrings(list(enumerate(texts)), 3)
    for least in (0, 10**9):  # all rows packed, none packed
        monkeypatch.setattr(fingerprints, "PACKED", least)
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.substring_dedup(docs, 3).collect()} == want
        assert {r.doc_id: r.component_id for r in ngram_join.ngram_join(docs, 4, 85).collect()} == {d: c for d, (_, c) in plain_components(list(enumerate(texts)), 4, 85).items()}


def test_windows_of_equal_hash_and_other_words_are_apart(spark, monkeypatch):
    """Were all 64-bit hashes equal, the second hash would still tell windows of different groups apart."""
    data, offsets = textops.utf8(pa.array(["a b c d", "a b c d", "a b c e"]))
    w = textops.words(data, offsets)
    checks = textops.window_checks(w, 3)
    assert len(checks) == 6 and checks[0] == checks[2] == checks[4] and checks[1] == checks[3] != checks[5]

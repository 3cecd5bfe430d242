"""Nearest neighbours, the classifier, the language model, secrets and decontamination."""

import random
import re
import zlib

import numpy as np
import pytest

from margrave.llm import cross_polytope, decontaminate, pseudo_likelihood, quality_knn, secrets
from tests.llm.common import SCHEMA, awkward, rows, sample


def clustered(n=1500, d=24, seed=1):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(12, d))[rng.integers(0, 12, n)] + 0.6 * rng.normal(size=(n, d))


def brute(x, ids, q, k):
    s = x[q] @ x.T
    s[np.arange(len(q)), q] = -np.inf
    return {int(ids[i]): [int(ids[j]) for j in np.lexsort((ids, -row))[:k]] for i, row in zip(q, s, strict=True)}


def test_recall_and_scores(spark):
    x = clustered()
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], "vec_id long, embedding array<double>, score string")
    got = cross_polytope.nearest(df, df.where("vec_id % 20 = 0"), 20).collect()
    want = brute(x, np.arange(len(x)), np.arange(0, len(x), 20), 20)
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r.rank] = r.vec_id
        assert abs(r.score - float(x[r.query_id] @ x[r.vec_id])) < 1e-9
    hit = sum(len(set(found[q].values()) & set(v)) for q, v in want.items())
    assert hit >= 0.9 * 20 * len(want)
    assert all(sorted(v) == list(range(1, 21)) for v in found.values())


def test_ties_few_and_bad_vectors(spark):
    good = [(i, [1.0, 0.0]) for i in range(30)] + [(40, [0.5, 0.5])]
    bad = [(50, None), (51, [0.0, 0.0]), (52, [float("nan"), 1.0]), (53, [None, 1.0]), (None, [1.0, 0.0]), (54, [float("inf"), 0.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>")
    got = cross_polytope.nearest(df, df, 5).collect()
    assert {r.query_id for r in got} == {i for i, _ in good}
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 3), key=lambda r: r.rank)] == [0, 1, 2, 4, 5]
    two = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r.vec_id, r.score) for r in cross_polytope.nearest(two, two, 20).collect()) == [(1, 2, 5.0), (2, 1, 5.0)]
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert cross_polytope.nearest(none, none).count() == 0


def test_hot_bucket_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(cross_polytope, "BLOCK", 64)
    rng = np.random.default_rng(2)
    x = np.concatenate([np.tile([1.0, 0, 0, 0], (400, 1)) + 1e-3 * rng.normal(size=(400, 4)), rng.normal(size=(100, 4))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in cross_polytope.nearest(df, df.where("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute(x, np.arange(500), np.arange(0, 500, 20), 20)
    assert sum(len(got[q] & set(v)) for q, v in want.items()) >= 0.9 * 20 * len(want)


def test_two_functions_and_hadamard():
    x = np.random.default_rng(3).normal(size=(50, 32))
    z = cross_polytope.hadamard(x)
    assert np.allclose((z * z).sum(1), (x * x).sum(1)) and np.allclose(cross_polytope.hadamard(z), x)
    c = cross_polytope.codes(x, 0, 2, 6)
    assert c.shape == (50, 6) and all(len(set(r)) == 6 for r in c.tolist()) and c.max() < 64 * 64
    assert cross_polytope.tuning(10**7)[0] == 2 and cross_polytope.tuning(50)[1] >= 256


@pytest.mark.parametrize(("pad", "functions"), [(1100, None), (64, 2)])
def test_recall_of_wide_vectors_and_two_functions(spark, pad, functions):
    x = np.concatenate([np.random.default_rng(7).normal(size=(600, 64)), np.zeros((600, pad - 64))], 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in cross_polytope.nearest(df, df.where("vec_id % 20 = 0"), 20, functions=functions).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute(x, np.arange(600), np.arange(0, 600, 20), 20)
    assert sum(len(got[q] & set(v)) for q, v in want.items()) >= 0.9 * 20 * len(want)


def test_probes_are_the_best_and_as_many_as_needed():
    x = np.random.default_rng(4).normal(size=(40, 8))
    y = np.repeat(x, 3, 0) + 0.3 * np.random.default_rng(5).normal(size=(120, 8))
    of = np.repeat(np.arange(40), 3)
    z = [np.concatenate([r, -r], 1) for r in (cross_polytope.rotated(x, 0, f) for f in range(2))]
    every = (z[0][:, :, None] + z[1][:, None, :]).reshape(40, 256)
    assert np.allclose(np.take_along_axis(every, cross_polytope.codes(x, 0, 2, 30), 1), -np.sort(-every, axis=1)[:, :30])
    for f in (1, 2):
        p = cross_polytope.needed(x, y, of, 2, f)
        met = lambda m: np.any([(cross_polytope.codes(x, t, f, m)[of] == cross_polytope.codes(y, t, f, 1)).any(1) for t in range(2)], 0).mean()
        assert p > 1 and met(p) >= cross_polytope.RECALL > met(p - 1)
    # either side of the switch one function is the cheaper, if it takes few probes
    assert cross_polytope.tuning(1_048_576)[0] == 1 and cross_polytope.tuning(1_048_577)[0] == 2 and cross_polytope.tuning(1_048_577, 4096)[0] == 1
    assert cross_polytope.cost(1_100_000, 256, 16, 1, 8) < cross_polytope.cost(1_100_000, 256, 16, 2, 601)


def test_held_out_is_crc32(spark):
    got = spark.range(50).select("id", quality_knn.held_out(__import__("pyspark").sql.functions.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


def test_classifier_on_held_out_labels(spark, small):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scores = {r.doc_id: r.score for r in quality_knn.score_quality(docs, quality_knn.fit_quality(docs, labels)).collect()}
    held = [(r.quality, scores[r.doc_id]) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 50 and sum((s >= 0.7) == (q == 1) for q, s in held) >= 0.95 * len(held)
    assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores.values())


def test_classifier_awkward(spark):
    docs = spark.createDataFrame(awkward(), SCHEMA)
    labels = spark.createDataFrame([(7, 1, 0), (8, 1, 0), (5, 0, 0), (5, 0, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    out = quality_knn.score_quality(docs.withColumnRenamed("g", "score"), quality_knn.fit_quality(docs, labels))
    assert out.count() == len(awkward()) and out.where("score is null or score < 0 or score > 1").count() == 0
    none = quality_knn.fit_quality(docs, labels.limit(0))
    assert {r.score for r in quality_knn.score_quality(docs, none).collect()} == {0.5}
    assert quality_knn.score_quality(spark.createDataFrame([], SCHEMA), none).count() == 0


def test_voting_is_exact():
    rng = np.random.default_rng(5)
    counts, labels = rng.random((40, quality_knn._BINS)).astype(np.float32), rng.integers(0, 2, 40)
    v = quality_knn.Voters.fit(counts, labels, 8)
    score = v.score(counts[:5])
    x = quality_knn._unit(quality_knn._unit(counts * v.weight) @ v.axes)
    for i in range(5):
        near = x[i] @ v.vectors.T
        top = np.argsort(-near)[: quality_knn.NEIGHBOURS]
        w = np.maximum(near[top], 0).astype(float) ** quality_knn.SHARPNESS
        assert abs(score[i] - (w * labels[top]).sum() / w.sum()) < 1e-5


def plain_features(text):
    """Log counts of a text, a word and a character at a time."""
    data = (text or "").encode()
    tokens, out = data.lower().split(), np.zeros(quality_knn._BINS)
    for t in tokens:
        out[int(quality_knn.words(np.frombuffer(t, np.uint8), np.array([0, len(t)])).hash[0]) % quality_knn.WORD_BINS] += 1
    for a, b, c in zip(data, data[1:], data[2:]):
        a, b, c = (int(quality_knn._KIND[x]) for x in (a, b, c))
        out[quality_knn.WORD_BINS + quality_knn._SHAPE_BIN[(a * quality_knn._KINDS + b) * quality_knn._KINDS + c]] += 1
    out = np.log1p(out)
    out[-1] = quality_knn.REPEAT_SCALE * sum(a == b for a, b in zip(tokens, tokens[1:])) / max(1, len(tokens))
    return out


def plain_votes(voters, texts):
    """{id: score}, a document and a voter at a time."""
    out = {}
    unit = lambda x: x / (np.linalg.norm(x) or 1)
    for d, text in texts.items():
        x = unit(unit(plain_features(text) * voters.weight) @ voters.axes)
        near = sorted(((float(x @ v), label) for v, label in zip(voters.vectors, voters.labels)), reverse=True)
        last = near[: quality_knn.NEIGHBOURS][-1][0]
        votes = [(max(s, 0) ** quality_knn.SHARPNESS, label) for s, label in near if s >= last - quality_knn.TIE]
        total = sum(w for w, _ in votes)
        out[d] = sum(w * label for w, label in votes) / total if total > 1e-12 else float(voters.labels.mean())
    return out


def test_voters_that_tie_all_vote():
    x = np.zeros((40, quality_knn._BINS), np.float32)
    x[:20, 0], x[20:, 1] = 1, 1
    labels = np.array([0] * 10 + [1] * 10 + [0] * 20)
    for order in (np.arange(40), np.random.default_rng(2).permutation(40)):
        score = quality_knn.Voters.fit(x[order], labels[order], 2).score(x[[0, 30]])
        assert score == pytest.approx([0.5, 0], abs=1e-6)  # 20 voters are equally near, and 15 are asked for


def test_network_learns_and_sums(spark):
    rng = random.Random(1)
    order = {w: f"x{(i + 1) % 12}" for i, w in enumerate(f"x{k}" for k in range(12))}
    texts = []
    for _ in range(300):
        w = [f"x{rng.randrange(12)}"]
        for _ in range(60):
            w.append(order[w[-1]])
        texts.append(" ".join(w))
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    untrained = pseudo_likelihood.score(docs, pseudo_likelihood.train(docs, rounds=0)).selectExpr("sum(log_likelihood) / sum(n_tokens)").first()[0]
    net = pseudo_likelihood.train(docs, rounds=2)
    trained = pseudo_likelihood.score(docs, net).selectExpr("sum(log_likelihood) / sum(n_tokens)").first()[0]
    assert untrained == pytest.approx(-np.log(12), abs=0.3) and trained > untrained + 0.5
    token, doc = np.array([0, 1, 2, 3, 0, 1]), np.array([0, 0, 0, 0, 1, 1])
    every = [net.log_probabilities(np.where(np.arange(6) == 2, v, token), doc)[2] for v in range(pseudo_likelihood._V)]
    assert np.exp(every).sum() == pytest.approx(1, abs=1e-4)  # a distribution over the masked token
    assert net.contexts(token, doc)[3].tolist() == [1, 2, pseudo_likelihood._V, pseudo_likelihood._V]


def test_words_of_a_bucket_have_their_own_probabilities(spark):
    often = " ".join(f"v{i}" for i in range(pseudo_likelihood.WORDS))
    texts = [often] * 40 + ["rare"] * 20 + [f"once{i}" for i in range(300)]
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    net = pseudo_likelihood.train(docs, rounds=0)
    assert net.counts.count() == 301 and net.counts.agg({"n": "sum"}).first()[0] == 320
    # alone in a text, all buckets are as likely: what differs is the share of the bucket
    new = [(0, "rare"), (1, "once7"), (2, "never"), (3, "rare rare"), (None, "rare")]
    out = pseudo_likelihood.score(spark.createDataFrame(new, "doc_id long, text string"), net).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == 5 and got[0].log_likelihood == got[None].log_likelihood and got[3].n_tokens == 2
    assert got[0].log_likelihood > got[1].log_likelihood + 1 and got[0].log_likelihood > got[2].log_likelihood + 1
    # the shares of a bucket's words and of one unseen word make up the bucket
    kept = net.counts.toArrow()
    bucket = kept["h"].to_numpy() & (pseudo_likelihood.BUCKETS - 1)
    weight = np.bincount(bucket, kept["n"].to_numpy() + pseudo_likelihood.ADDED, pseudo_likelihood.BUCKETS) + pseudo_likelihood.ADDED
    assert np.allclose(weight, net.totals)


def test_network_is_the_same_on_any_partitioning(spark, monkeypatch):
    monkeypatch.setattr(pseudo_likelihood, "SHARD_BYTES", 2000)
    docs = spark.createDataFrame(rows(sample(5, n=200, vocabulary=300)), SCHEMA)
    assert pseudo_likelihood.waves(9) == [(0, 1), (1, 3), (3, 7), (7, 9)]
    one, many = (pseudo_likelihood.train(docs.repartition(n)) for n in (1, 7))
    assert np.allclose(one.flat(), many.flat(), atol=1e-6) and not np.allclose(one.flat(), pseudo_likelihood.train(docs, rounds=0).flat(), atol=1e-3)
    a, b = ({r.doc_id: r.log_likelihood for r in pseudo_likelihood.score(docs.repartition(n), one).collect()} for n in (1, 7))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-6) for k in a)


def plain_sums(net, texts):
    """{id: (tokens, sum of ln P)}, a token at a time."""
    seen, out = dict(net.counts.collect()), {}
    e, b, wc, bc, ww, bw = (w.astype(float) for w in net.weights)
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    for d, text in texts.items():
        data, offsets = pseudo_likelihood.utf8(__import__("pyarrow").array([text], "string"))
        h = pseudo_likelihood.words(data, offsets, lower=True).hash
        token, total = net.tokens(h), 0.0
        for i, t in enumerate(token):
            hidden = b.copy()
            for c, o in enumerate(pseudo_likelihood.CONTEXT):
                hidden = hidden + e[c][token[i + o] if 0 <= i + o < len(token) else pseudo_likelihood._V]
            hidden, cluster = np.tanh(hidden), t // pseudo_likelihood.CLUSTER
            p = softmax(hidden @ wc + bc)[cluster] * softmax(hidden @ ww[cluster] + bw[cluster])[t % pseudo_likelihood.CLUSTER]
            if t >= pseudo_likelihood.WORDS:
                p *= (seen.get(int(h[i].view(np.int64)), 0) + pseudo_likelihood.ADDED) / net.totals[t - pseudo_likelihood.WORDS]
            total += np.log(p)
        out[d] = len(token), total
    return out


def test_score_is_the_plain_sum(spark):
    texts = [*sample(6, n=40, vocabulary=1500, words=90), "once", "never seen here", None, ""]
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    net = pseudo_likelihood.train(docs)
    want = plain_sums(net, dict(enumerate(texts)))
    for r in pseudo_likelihood.score(docs, net).collect():
        n, total = want.pop(r.doc_id)
        assert r.n_tokens == n and r.log_likelihood == pytest.approx(total, abs=1e-3 * max(1, n))
    assert not want


def test_network_awkward(spark):
    docs = spark.createDataFrame(awkward(), SCHEMA)
    out = pseudo_likelihood.score(docs, pseudo_likelihood.train(docs)).collect()
    assert len(out) == len(awkward())
    assert all((r.per_token is None) == (r.n_tokens == 0) and (r.n_tokens or r.log_likelihood == 0) for r in out)
    none = spark.createDataFrame([], SCHEMA)
    assert pseudo_likelihood.score(none, pseudo_likelihood.train(none)).count() == 0


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_base(t):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(spans)


def test_base_spans(spark):
    rng = random.Random(3)
    parts = ["password", "Token", "api_key", "apikey", '"', "'", " ", ":", "=", "abc.def", "AKIA", "ABCDEF0123456789", "deadbeef", "0123456789abcdef", "é", "😀", "\n", "x", "SECRET=", "ſecret="]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["0123456789abcdef", "deadbeefdeadbeef x", "", None]
    got = {r.doc_id: [tuple(s) for s in r.base] for r in secrets.find_secrets(spark.createDataFrame(rows(texts), SCHEMA)).collect()}
    assert got == {i: plain_base(t or "") for i, t in enumerate(texts)}


def test_random_tokens_are_found_and_words_are_not(spark):
    rng = random.Random(6)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(rng.choice(letters) for _ in range(44)) for _ in range(30)]
    texts = [f"see {k} here" for k in keys] + ["antidisestablishmentarianism and internationalization_of_words"] * 30 + ["AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA0"] + ["aB3" * 20]
    out = {r.doc_id: [tuple(s) for s in r.spans] for r in secrets.find_secrets(spark.createDataFrame(rows(texts), SCHEMA)).collect()}
    assert sum(out[i] == [(4, 3, 48)] for i in range(30)) >= 28
    assert not any(out[i] for i in range(30, len(texts)))


def test_random_tokens_after_names_and_in_paths(spark):
    rng = random.Random(8)
    key = lambda n, more="": "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789" + more) for _ in range(n))
    before = ["AWS_SECRET_ACCESS_KEY=", "auth=", "https://x.example/get?sig=", "/srv/my_app/config-files/", "a=b=c="]
    keys = [(b, key(40, "+/") if b.startswith("AWS") else key(32)) for b in before for _ in range(12)]
    texts = [f"see {b}{k} here" for b, k in keys] + ["AWS_SECRET_ACCESS_KEY=internationalization_of_words /usr/share/some_long_directory_name/another-long-name"] * 20
    out = {r.doc_id: [tuple(s) for s in r.spans] for r in secrets.find_secrets(spark.createDataFrame(rows(texts), SCHEMA)).collect()}
    found = [any(s == 3 and j <= 4 + len(b) + len(k) and i <= 4 + len(b) < j for i, s, j in out[n]) for n, (b, k) in enumerate(keys)]
    assert all(sum(found[i : i + 12]) >= 10 for i in range(0, 60, 12)), found
    assert not any(out[i] for i in range(60, 80))


ALPHABETS = {name: letters for name, _, letters in secrets.ENCODINGS}


def battery(spark, tokens, a):
    from pyspark.sql import functions as F

    rows = [(i, float(len(t)), [float(x) for x in t]) for i, t in enumerate(tokens)]
    df = spark.createDataFrame(rows, "i int, n double, at array<double>")
    return {r.i: r.p for r in df.select("i", secrets._battery(F.col("n"), F.lit(float(a)), F.col("at")).alias("p")).collect()}


@pytest.mark.parametrize("a", [16, 32, 36, 62, 64])
def test_battery_has_its_level_on_random_tokens(spark, a):
    """Simulated: of uniform tokens about as many or fewer have a p-value under a level, also where n is under a."""
    rng = np.random.default_rng(a)
    for n in (20, 40, 100):
        p = np.array(list(battery(spark, rng.integers(1, a + 1, (3000, n)).tolist(), a).values()))
        assert all((p <= level).mean() <= 1.5 * level + 0.002 for level in (0.1, 0.01, 0.001)), (n, [(p <= x).mean() for x in (0.1, 0.01, 0.001)])
        assert (p <= 0.5).mean() > 0.2


def test_battery_rejects_each_kind_of_order(spark):
    rng = np.random.default_rng(1)
    skewed = rng.choice(np.arange(1, 65), (50, 64), p=np.arange(1, 65)[::-1] ** 2 / (np.arange(1, 65) ** 2).sum()).tolist()
    alternating = [[int(x) for pair in zip(rng.integers(1, 33, 32), rng.integers(33, 65, 32)) for x in pair] for _ in range(50)]
    rising = [sorted(rng.integers(1, 65, 64).tolist()) for _ in range(50)]
    for tokens in (skewed, alternating, rising):
        assert np.median(list(battery(spark, tokens, 64).values())) < secrets.FALSE_DISCOVERIES


def test_keys_without_a_keyword_are_caught_and_prose_is_not(spark):
    rng = random.Random(12)
    texts, keys = [], {}
    for name in ("HEX", "base32", "base36", "base62", "base64", "base64url"):
        for n in (24, 40, 64):
            for _ in range(25):
                keys[len(texts)] = (name, n)
                texts.append("see " + "".join(rng.choice(ALPHABETS[name]) for _ in range(n)) + " there")
    prose = {
        "en": "counterrevolutionaries electroencephalographic internationalization uncharacteristically misunderstandings_of_the_words the/usual/places/of/letters",
        "de": "Donaudampfschifffahrtsgesellschaft Rindfleischetikettierung Geschwindigkeitsbegrenzung Versicherungsgesellschaften Krankenversicherungskarte",
        "fr": "anticonstitutionnellement institutionnalisation_des_mots professionnalisation-de-la-vie les/articles/du/journal/de/la/ville",
        "es": "electroencefalografista desafortunadamente_nosotros internacionalizaciones la/casa/de/los/abuelos/en/la/sierra",
    }
    words = [(lang, w) for lang, t in prose.items() for w in t.split(" ")]
    first = len(texts)
    texts += [w for _, w in words for _ in range(20)]
    out = {r.doc_id: [tuple(s) for s in r.spans] for r in secrets.find_secrets(spark.createDataFrame(rows(texts), SCHEMA)).collect()}
    caught = {}
    for i, k in keys.items():
        caught.setdefault(k, []).append(any(kind == 3 for _, kind, _ in out[i]))
    assert sum(map(sum, caught.values())) >= 0.95 * len(keys), {k: sum(v) / len(v) for k, v in caught.items()}
    false = [w for j, (_, w) in enumerate(words) if any(out[first + 20 * j + i] for i in range(20))]
    assert not false, false


def test_without_the_battery_ordered_tokens_would_pass(spark):
    """Tokens no prose has, but that the battery rejects: only its p-values keep them out."""
    rng = random.Random(14)
    keys = ["".join(rng.choice(ALPHABETS["base62"]) for _ in range(44)) for _ in range(40)]
    ordered = ["".join(sorted(k)) for k in keys] + ["".join(rng.choice("QXZ7J") for _ in range(44)) for _ in range(40)]
    out = {r.doc_id: r.spans for r in secrets.find_secrets(spark.createDataFrame(rows([*keys, *ordered]), SCHEMA)).collect()}
    assert sum(bool(out[i]) for i in range(40)) >= 38 and not any(out[i] for i in range(40, 120))


def test_secrets_awkward(spark):
    out = secrets.find_secrets(spark.createDataFrame(awkward(), SCHEMA)).select("doc_id", secrets.written("spans").alias("s")).collect()
    assert len(out) == len(awkward()) and all(r.s == "" for r in out)
    assert secrets.find_secrets(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "deadbeefdeadbeef " * 3000
    spans = secrets.find_secrets(spark.createDataFrame([(1, long)], "doc_id long, text string")).first().base
    assert [(s.start, s.end) for s in spans] == [(17 * i, 17 * i + 16) for i in range(3000)]


def test_discovery_line_is_benjamini_hochberg():
    rng = random.Random(1)
    powers = [rng.choice([0, 0, 0, 1, 2, 3, 4, 9]) for _ in range(200)]
    m, best = len(powers), 301
    for i, b in enumerate(sorted(powers, reverse=True), 1):
        if 0 < b and 10.0**-b <= secrets.FALSE_DISCOVERIES * sum(p >= b for p in powers) / m:
            best = b
    assert secrets.discovery_line({b: powers.count(b) for b in set(powers)}) == best


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(t):
    return WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))


def plain_hits(docs, items, k):
    windows = {}
    for item, t in items:
        w = plain_words(t)
        for i in range(max(1, len(w) - k + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    out = []
    for d, t in docs:
        w, hit, found = plain_words(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.mark.parametrize("k", [2, 3, 8])
def test_decontaminate(spark, k):
    items = [(10 + i, t) for i, t in enumerate(sample(20, n=12, words=14))] + [(1, "a, B"), (2, None), (3, ""), (4, "É日本"), (10, "Zz!")]
    texts = sample(20, n=30, words=14) + ["a b c", "x É日本", "the zz", None, "", "a-b"] + [f"q {t} q" for _, t in items if t]
    got = decontaminate.decontaminate(spark.createDataFrame(rows(texts), SCHEMA), spark.createDataFrame(items, "item_id long, text string"), k).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in got), key=str) == plain_hits(list(enumerate(texts)), items, k)


def test_decontaminate_awkward(spark):
    items = spark.createDataFrame([(1, "c d e f g h i j", 3), (None, "one", 3)], "item_id long, text string, n int")
    out = decontaminate.decontaminate(spark.createDataFrame(awkward(), SCHEMA), items).collect()
    assert sorted(((r.n_words, r.n_hit, r.item_ids) for r in out), key=str) == sorted(((n, h, i) for _, n, h, i in plain_hits([(r[0], r[1]) for r in awkward()], [(1, "c d e f g h i j")], 8)), key=str)
    none = decontaminate.decontaminate(spark.createDataFrame(awkward(), SCHEMA), items.limit(0))
    assert none.count() == len(awkward()) and none.where("n_hit > 0").count() == 0
    assert decontaminate.decontaminate(spark.createDataFrame([], SCHEMA), items).count() == 0


def test_native_operators_run_no_python(spark):
    docs = spark.createDataFrame(awkward(), SCHEMA)
    items = spark.createDataFrame([(1, "c d e f g h i j")], "item_id long, text string")
    for df in (secrets.find_secrets(docs), decontaminate.decontaminate(docs, items)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())

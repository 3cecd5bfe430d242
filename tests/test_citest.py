"""G-tests in every strategy against a plain version, and the algorithms over them."""

import itertools
import math
import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from margrave.errors import InsufficientSamples
from margrave.operators.citest import CITestConfig, CITester, Request, all_requests, disagreements
from margrave.operators.bayesnet import BayesianNetwork
from margrave.plans.boundary import cmi_heuristic, distance_heuristic, iamb, information_gain_ranking, ipcmb, ipcmb_all, network_cmi_heuristic, pcmb, separation_heuristic
from margrave.queries import garden

COLS = ["a", "b", "c", "d"]


def data(spark, seed=1, n=400):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        a = rng.choice("xyz")
        b = a if rng.random() < 0.6 else rng.choice("xyz")
        rows.append((a, b, rng.randrange(2), None if rng.random() < 0.1 else rng.randrange(3)))
    return rows, spark.createDataFrame(rows, "a string, b string, c int, d int").cache()


def plain(rows, x, y, z):
    at = {c: i for i, c in enumerate(COLS)}
    key = lambda r, cs: tuple(r[at[c]] for c in cs)
    xyz, xz, yz, zz = (Counter(key(r, c) for r in rows) for c in ((x, y, *z), (x, *z), (y, *z), z))
    g = 2 * abs(sum(n * math.log(n * zz[k[2:]] / (xz[k[0], *k[2:]] * yz[k[1], *k[2:]])) for k, n in xyz.items()))
    dof = sum((sum(k[1:] == s for k in xz) - 1) * (sum(k[1:] == s for k in yz) - 1) for s in zz)
    return g, max(1, dof)


@pytest.mark.parametrize("strategy", ["direct", "cuboid", "entropy"])
def test_strategies_match_a_plain_version(spark, strategy):
    rows, df = data(spark)
    tester = CITester(df, COLS, CITestConfig(strategy=strategy))
    requests = all_requests(COLS)
    assert len(requests) == 4 * 3 // 2 * 2**2
    for q, r in zip(requests, tester.batch(requests), strict=True):
        g, dof = plain(rows, q.x, q.y, q.z)
        assert r.g == pytest.approx(g, abs=1e-8) and r.dof == dof and r.n == 400
        assert r.insufficient == (not 5 * dof < 400)
        assert (r.independent is None) if r.insufficient else r.independent == (r.p < 0.95)


def test_streams_of_results_agree(spark):
    _, df = data(spark, 2)
    frames = []
    for s in ("direct", "cuboid", "entropy"):
        tester = CITester(df, COLS, CITestConfig(strategy=s))
        tester.batch(all_requests(COLS))
        frames.append(tester.frame().cache())
    assert disagreements(frames[0], frames[1]).isEmpty() and disagreements(frames[0], frames[2]).isEmpty()
    assert disagreements(frames[0], frames[1].limit(3)).count() == 21


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 2), st.integers(0, 1), st.integers(0, 1)), min_size=1, max_size=40))
def test_property_direct_equals_entropies(spark, rows):
    df = spark.createDataFrame(rows, "a int, b int, c int, d int")
    q = [Request.of("a", "b", ["c"]), Request.of("a", "d")]
    got = [CITester(df, COLS, CITestConfig(strategy=s)).batch(q) for s in ("direct", "entropy")]
    for a, b, r in zip(*got, q, strict=True):
        g, dof = plain(rows, r.x, r.y, r.z)
        assert a.g == pytest.approx(g, abs=1e-8) and b.g == pytest.approx(g, abs=1e-8) and a.dof == b.dof == dof


def test_insufficient_samples_and_caches(spark, tmp_path):
    rows, df = data(spark, 3, 20)
    path = {"entropy_path": f"file://{tmp_path}/h", "dof_path": f"file://{tmp_path}/d", "results_path": f"file://{tmp_path}/r"}
    tester = CITester(df, COLS, CITestConfig(strategy="entropy", **path))
    with pytest.raises(InsufficientSamples):
        tester.conditionally_independent("a", "b", ["d"])
    tester.end()
    again = CITester(df, COLS, CITestConfig(strategy="entropy", **path))
    again.test("a", "b", ["d"])
    assert again.misses == 0 and again.reads == 4
    assert spark.read.parquet(path["results_path"]).first().insufficient is True
    lax = CITester(df, COLS, CITestConfig(sufficient=lambda n, dof: n > 0))
    assert lax.test("a", "b", ["d"]).independent is not None
    assert CITester(df, COLS, CITestConfig(dof="unadjusted")).test("a", "b", ["d"]).dof == 2 * 2 * len({r[3] for r in rows})


def test_igt_golden(spark):
    # features 0 and 4 equal the objective or its inverse, 1 and 5 tell half as much, others less
    rows = [tuple(int(b) for b in f"{i:04b}") + (i % 2, i // 4 % 2, int(i % 2 == 0)) for i in range(16)]
    df = spark.createDataFrame(rows, "f0 int, f1 int, f2 int, f3 int, y int, f5 int, f6 int")
    feats = ["f0", "f1", "f2", "f3", "f5", "f6"]
    assert information_gain_ranking(df, feats, "y", 3) == ["f3", "f6", "f0"]
    assert information_gain_ranking(df, feats, "y", 3, binary=True) == ["f3", "f6", "f0"]


DIAMOND = {"a": ["b", "c"], "b": ["d"], "c": ["d"], "d": ["e"], "e": []}
WIDE = {"r": ["s", "t"], "s": ["u"], "t": ["u", "v"], "u": ["w"], "v": ["w", "x"], "w": [], "x": ["y"], "y": [], "z": ["y"]}


@pytest.mark.parametrize("edges", [DIAMOND, WIDE])
def test_boundaries_by_separation(spark, edges):
    net = BayesianNetwork.from_edges(edges)
    tester = lambda: CITester(spark.range(1), net.names, CITestConfig(strategy="dsep", network=net))
    want = {t: net.markov_boundary(t) for t in net.names}
    assert ipcmb_all(tester()) == want
    assert {t: ipcmb(tester(), t) for t in net.names} == want
    assert {t: pcmb(tester(), t, separation_heuristic(net)) for t in net.names} == want
    assert {t: ipcmb(tester(), t, pc_only=True) for t in net.names} == {t: net.neighbours[t] for t in net.names}
    assert {t: iamb(tester(), t, distance_heuristic(net)) for t in net.names} == want


def test_boundaries_from_samples(spark):
    net = garden()
    df = net.sample(spark, 30_000, seed=3).cache()
    want = {t: net.markov_boundary(t) for t in net.names}
    for s in ("cuboid", "entropy"):
        assert ipcmb_all(CITester(df, net.names, CITestConfig(significance=0.99, strategy=s, network=net))) == want
    tester = CITester(df, net.names, CITestConfig(significance=0.99, strategy="cuboid", network=net))
    assert iamb(tester, "grass", cmi_heuristic(tester)) == want["grass"]
    assert sum(r.accurate() for r in tester.results) == len(tester.results)


def test_network_heuristic_matches_enumeration(spark):
    net, q = garden(), Request.of("rain", "sprinkler", ["season"])
    assert network_cmi_heuristic(net, spark)([q, Request.of("season", "rain")])[0] == pytest.approx(0, abs=1e-9)
    big = network_cmi_heuristic(net, spark)([Request.of("sprinkler", "rain", ["grass"])])[0]
    cells = [(r.sprinkler, r.rain, r.grass, r.p) for r in net.joint(spark).collect()]
    p = Counter()
    for s, r, g, v in cells:
        for k in ((s, r, g), (s, None, g), (None, r, g), (None, None, g)):
            p[k] += v
    want = sum(p[s, r, g] * math.log(p[s, r, g] * p[None, None, g] / (p[s, None, g] * p[None, r, g])) for s, r, g in itertools.product(["off", "on"], ["none", "some", "much"], ["dry", "wet"]))
    assert big == pytest.approx(want, abs=1e-9)

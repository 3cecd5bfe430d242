"""Unions of column sets, stored counts, plug points, records, folders on any file system, the command line."""

import itertools
import json
import math
import random
import sys

import pytest

from margrave import __main__ as cli
from margrave import experiment as exp
from margrave.dataset import Dataset, numbered
from margrave.errors import LockedPathError
from margrave.operators import bayesnet
from margrave.operators import counts as ct
from margrave.operators.citest import CITestConfig, CITester, Request, covers
from margrave.operators.cuboids import CuboidCache
from margrave.plans import harness
from margrave.plans.boundary import cmi_heuristic, iamb, ipcmb, ipcmb_all, network_cmi_heuristic
from margrave.queries import garden
from margrave.storage import before, ranged


def test_covers_hold_their_sets_and_stay_small():
    rng = random.Random(1)
    size = {f"c{i:02d}": rng.choice((2, 3, 4, 40)) for i in range(12)}
    sets = [tuple(sorted(s)) for k in (0, 1, 2, 3) for s in itertools.combinations(size, k)]
    found = covers(sets, size.__getitem__, 500)
    assert sorted(i for _, members in found for i in members) == list(range(len(sets)))
    for union, members in found:
        assert all(set(sets[i]) <= set(union) for i in members)
        assert math.prod(size[c] for c in union) <= 500 or len({sets[i] for i in members}) == 1 or union in [sets[i] for i in members]
    triples = list(itertools.combinations(sorted(size), 3))
    assert len(covers(triples, lambda _: 2, 500)) < len(triples) / 3
    assert [members for _, members in covers(triples, lambda _: 2, 0)] == [[i] for i in range(len(triples))]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    data = [(a, (a + rng.randint(0, 1)) % 3, rng.choice("xyz"), None if rng.random() < 0.1 else rng.randint(0, 4)) for a in (rng.randint(0, 2) for _ in range(900))]
    return spark.createDataFrame(data, "a int, b int, c string, d int")


def plain_cells(rows, cols):
    out = {}
    for r in rows.collect():
        out[tuple(r[c] for c in cols)] = out.get(tuple(r[c] for c in cols), 0) + 1
    return sorted(out.values())


@pytest.mark.parametrize("strategy", ["direct", "cuboid", "entropy"])
def test_cells_are_the_same_from_samples_unions_and_cuboids(rows, strategy):
    tester = CITester(rows, rows.columns, CITestConfig(strategy=strategy))
    sets = [s for k in (1, 2, 3, 4) for s in itertools.combinations(rows.columns, k)]
    for _ in range(2):
        got = {}
        for r in tester.counter.cells(sets).collect():
            got.setdefault(r["set"], []).append(r["n"])
        assert {i: sorted(v) for i, v in got.items()} == {i: plain_cells(rows, s) for i, s in enumerate(sets)}
    assert tester.counter.scans == (1 if strategy == "cuboid" else 2)


def test_preloaded_cuboids_answer_without_the_samples(rows):
    cache = CuboidCache(rows, rows.columns, admit=1.0)
    cache.build([("a", "b", "c"), ("c", "d")])
    asked = [Request.of("a", "b"), Request.of("a", "b", ["c"]), Request.of("c", "d")]
    tester = CITester(rows, rows.columns, CITestConfig(cuboids=cache))
    want = CITester(rows, rows.columns).batch([*asked, Request.of("a", "d")])
    got = tester.batch(asked)
    assert tester.counter.scans == 0 and all(g.close_to(w, 1e-9) for g, w in zip(got, want))
    assert tester.batch([Request.of("a", "d")])[0].close_to(want[3], 1e-9) and tester.counter.scans == 1


def test_entropies_and_dofs_come_in_one_job(rows):
    tester, other = (CITester(rows, rows.columns, CITestConfig(strategy=s)) for s in ("entropy", "direct"))
    asked = [Request.of(x, y, z) for x, y in itertools.combinations(rows.columns, 2) for k in (0, 1, 2) for z in itertools.combinations([c for c in rows.columns if c not in (x, y)], k)]
    assert all(a.close_to(b, 1e-8) for a, b in zip(tester.batch(asked), other.batch(asked)))
    assert tester.counter.scans == 1
    tester.batch(asked)
    assert tester.counter.scans == 1
    own = dict(tester.entropies)
    again = CITester(rows, rows.columns, CITestConfig(strategy="entropy"))
    again.learn_entropies(own)
    assert all(again.entropies[k] == pytest.approx(v, abs=1e-9) for k, v in own.items())


@pytest.mark.parametrize("strategy", ["direct", "entropy"])
def test_own_degrees_of_freedom(rows, strategy):
    seen = []

    def own(tester, q, structural):
        seen.append(structural)
        return tester.unadjusted(q) + 1

    tester = CITester(rows, rows.columns, CITestConfig(strategy=strategy, dof=own))
    r = tester.test("a", "b", ["c"])
    assert r.dof == 2 * 2 * 3 + 1 and (seen[0] is None) == (strategy == "entropy")


def test_scores_are_kept_and_stored(spark, rows, tmp_path):
    tester = CITester(rows, rows.columns, CITestConfig(heuristic_results_path=f"file://{tmp_path}/scores"))
    iamb(tester, "a")
    first = tester.scores[:3]
    assert [(s.heuristic, s.x, s.y, s.z) for s in first] == [("cmi", "a", c, ()) for c in ("b", "c", "d")]
    values = cmi_heuristic(tester)([Request.of("a", c) for c in ("b", "c", "d")])
    assert [s.value for s in first] == pytest.approx(values) and "cmi(a, b | ∅)" in str(first[0])
    tester.end()
    stored = spark.read.parquet(f"file://{tmp_path}/scores").orderBy("idx").collect()
    assert [r.value for r in stored] == [s.value for s in tester.scores] and all(r.duration_s > 0 for r in stored)


def test_network_scores_of_a_batch(spark):
    net = garden()
    asked = [Request.of("grass", "rain", ["season"]), Request.of("grass", "slippery"), Request.of("rain", "sprinkler", ["season"])]
    together = network_cmi_heuristic(net, spark)(asked)
    assert together == pytest.approx([network_cmi_heuristic(net, spark)([q])[0] for q in asked])
    assert together[2] == pytest.approx(0, abs=1e-12) and together[0] > 0.1 and network_cmi_heuristic(net, spark)([]) == []


def test_all_targets_ask_for_spouses_at_once(spark):
    net, batches = garden(), []
    data = net.sample(spark, 3000, seed=3)
    tester = CITester(data, net.names, CITestConfig(significance=0.9))
    asked = tester.batch
    tester.batch = lambda requests: batches.append(len(requests)) or asked(requests)
    found = ipcmb_all(tester)
    levels = sum(n > 0 for n in batches)
    assert found == {t: ipcmb(CITester(data, net.names, CITestConfig(significance=0.9)), t) for t in net.names}
    assert levels <= 6


def test_places_and_sums_over_range_partitions(spark):
    df = spark.range(500).selectExpr("id", "id % 7 as k", "(id * 37) % 11 as w").repartition(6)
    want = sorted((r.k, r.id, r.w) for r in df.collect())
    assert [(r.k, r.id) for r in numbered(df, "k", "id").orderBy("rn").collect()] == [(k, i) for k, i, _ in want]
    sums = {r.id: r["s"] for r in before(ranged(df, "k", "id"), __import__("pyspark").sql.functions.col("w"), "s").collect()}
    total = 0
    for _, i, w in want:
        assert sums[i] == total
        total += w


def test_many_copies_of_a_key(spark, monkeypatch):
    monkeypatch.setattr(bayesnet, "COPIES", 7)
    net = garden()
    rows = net.exact_samples(spark, 300)
    assert rows.count() == 300 and rows.select("row_id").distinct().count() == 300
    counts = {tuple(r[c] for c in net.names): r["n"] for r in ct.value_counts(net.exact_samples(spark, 300, indices=False), *net.names).collect()}
    assert counts == {tuple(r[c] for c in net.names): r["n"] for r in ct.exact_instances(net.joint(spark), 300).collect()}


@pytest.mark.parametrize("remote", [False, True])
def test_folders_and_locks(spark, tmp_path, remote):
    place = exp.LockablePath(f"file://{tmp_path}" if remote else tmp_path, "f", "thing", spark if remote else None)
    assert not place.exists() and place.locks() == [] and not place.locked()
    place.lock()
    place.lock("other")
    assert place.locks() == ["other", "thing"] and place.locked("thing") and not place.locked("third")
    (tmp_path / "f" / "part").mkdir()
    with pytest.raises(LockedPathError):
        place.delete_subfolder("part")
    place.unlock("other")
    place.unlock()
    with pytest.raises(LockedPathError):
        place.delete("nothing")
    place.delete_subfolder("part")
    assert place.exists() and not (tmp_path / "f" / "part").exists()
    place.delete()
    assert not place.exists()


def test_grid_and_stored_statistics(spark, rows, tmp_path):
    runs = harness.grid(rows, rows.columns, admits=(0.0, 0.5))
    assert [r["tag"] for r in runs] == ["unoptimized", "static_0", "static_500", "dynamic_0", "dynamic_500", "entropy"]
    done = harness.run_grid(rows, rows.columns, [runs[0], runs[2], runs[4]])
    assert len({json.dumps(r["boundaries"], sort_keys=True) for r in done}) == 1 and done[1]["scans"] == 0 < done[0]["scans"]
    cache = CuboidCache(rows, rows.columns, admit=1.0, path=f"file://{tmp_path}/c")
    cache.build([("a", "b"), ("c",)])
    stats = harness.stored_stats(cache)
    assert [(s["columns"], s["cells"]) for s in stats] == [(["a", "b"], len(plain_cells(rows, ["a", "b"]))), (["c"], 3)] and all(s["bytes"] > 0 for s in stats)
    assert harness.cuboid_stats(rows, ["a", "c"])["bytes"] > 0


MODULE = """
from margrave.experiment import DatasetDefinition, Experiment
from margrave.sources.base import IdentitySource

def found(data, params):
    return [params["target"] + "1"]

def source():
    from pyspark.sql import SparkSession
    return IdentitySource(SparkSession.getActiveSession())

EXPERIMENTS = [Experiment("e1", {root!r}, lambda: None, [{{"algorithm": found, "target": t, "tags": [t]}} for t in "abc"])]
DATASETS = [DatasetDefinition("d1", {root!r}, source, tags=("small",))]
"""


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "defs_of_test.py").write_text(MODULE.format(root=str(tmp_path / "r")))
    monkeypatch.syspath_prepend(str(tmp_path))
    sys.modules.pop("defs_of_test", None)

    def out(*argv):
        cli.main(list(argv))
        return capsys.readouterr().out.split("\n")[:-1]

    m = "defs_of_test"
    assert out("paths", m) == [f"experiments e1 {tmp_path}/r/e1", f"datasets d1 {tmp_path}/r/d1"]
    assert out("exp", "list", m) == ["e1 3"] and out("parameters", "count", m, "e1", "--tag", "b") == ["1"]
    assert [json.loads(x)["target"] for x in out("parameters", "list", m, "e1", "--range", "1-2")] == ["b", "c"]
    assert out("exp", "run", m, "e1") == ["run_0 found a a1", "run_1 found b b1", "run_2 found c c1"]
    assert out("exp", "locks", m, "e1") == ["experiment"] and json.loads(out("exp", "show", m, "e1")[0])["locks"] == ["experiment"]
    out("exp", "unlock", m, "e1", "--kind", "experiment")
    out("exp", "delete", m, "e1")
    assert not (tmp_path / "r" / "e1").exists()
    assert json.loads(out("exds", "build", m, "d1")[0])["rows"] == 8 and out("exds", "locks", m, "d1") == ["dataset"] and out("exds", "list", m) == ["d1 small dataset"]
    with pytest.raises(SystemExit):
        cli.main(["exp", "show", m, "nothing"])


def test_dataset_of_a_saved_label_loads(spark, tmp_path):
    from margrave.dataset import load_or_build

    data = Dataset.of(spark.range(4).withColumnRenamed("id", "x"), ["x"])
    first = load_or_build(spark, f"file://{tmp_path}", "own", lambda: data)
    assert load_or_build(spark, f"file://{tmp_path}", "own", lambda: pytest.fail("built again")).df.count() == 4 and first.label == "own"

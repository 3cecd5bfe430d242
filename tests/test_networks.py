"""Networks, sources, datasets, experiments."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from margrave import experiment as exp
from margrave.dataset import Dataset, SplitDataset, SplitOptions, columns_to_remove, load_or_build, split_rows
from margrave.errors import DatasetFinalizedError, DatasetNotFinalizedError, ExperimentLockedError, LockedPathError, NetworkNotFinalizedError, UnequalCounts
from margrave.operators.bayesnet import BayesianNetwork, path_frame
from margrave.operators.counts import min_sample_size
from margrave.queries import GARDEN, garden
from margrave.sources.base import IdentitySource
from margrave.sources.bif import BIFError, parse_bif, read_bif
from margrave.sources.bn_sample import NetworkSampleSource
from margrave.sources.doc_term import DocTermSource, read_ids, read_relevance, read_tokens
from margrave.sources.matrix_market import load_dataset, read_matrix
from margrave.sources.synthetic_binary import SyntheticBinarySource
from margrave.streaming.contingency import windowed_counts, windowed_mi


def test_bif(tmp_path, spark):
    (tmp_path / "g.bif").write_text(GARDEN)
    for net in (read_bif(str(tmp_path / "g.bif")).finalize(), read_bif(f"file://{tmp_path}/g.bif", spark).finalize()):
        assert net.names == ["grass", "rain", "season", "slippery", "sprinkler"] and net.joint_size() == 48
        assert net.nodes["grass"].probability("wet", ("off", "some")) == 0.7
    assert parse_bif("network n { property a b; property c \"d e\"; }").properties == {"a": "b", "c": "d e"}
    for bad in ("variable x { type discrete [ 3 ] { a, b }; }", "graph x { }", "variable x { type @ }"):
        with pytest.raises(BIFError):
            parse_bif(bad)
    with pytest.raises(NetworkNotFinalizedError):
        parse_bif(GARDEN).d_separated("rain", [], "grass")


def test_finalizing_twice_changes_nothing():
    net = garden()
    order = list(net.order)
    assert net.finalize().order == order and order.index("season") < order.index("rain") < order.index("grass")
    with pytest.raises(ValueError):
        BayesianNetwork.from_edges({"a": ["b"], "b": ["a"]})


def test_joint_and_partial(spark):
    net = garden()
    joint = {tuple(r[n] for n in net.names): r.p for r in net.joint(spark).collect()}
    assert len(joint) == 48 and sum(joint.values()) == pytest.approx(1)
    assert joint["wet", "some", "dry", "yes", "on"] == pytest.approx(0.6 * 0.7 * 0.2 * 0.95 * 0.6)
    part = {(r.grass, r.season): r.p for r in net.partial_joint(spark, ["season", "grass"]).collect()}
    want = {}
    for k, p in joint.items():
        want[k[0], k[2]] = want.get((k[0], k[2]), 0) + p
    assert part == pytest.approx(want)
    assert net.ancestors(["rain"]) == ["rain", "season"] and net.subnetwork(["rain"]).joint_size() == 6
    assert min_sample_size(net.joint(spark)) == round(1 / min(p for p in joint.values()))


def test_samples(spark):
    net = garden()
    df = net.sample(spark, 50_000, seed=4)
    assert df.exceptAll(net.sample(spark, 50_000, seed=4, partitions=7)).isEmpty()
    assert not df.exceptAll(net.sample(spark, 50_000, seed=5)).isEmpty()
    got = {r.rain: r["count"] / 50_000 for r in df.groupBy("rain").count().collect()}
    want = {i: sum(net.nodes["season"].probability(s) * net.nodes["rain"].probability(v, (s,)) for s in ("dry", "wet")) for i, v in enumerate(net.nodes["rain"].values)}
    assert all(abs(got[i] - want[i]) < 0.008 for i in want)
    named = net.sample(spark, 100, indices=False)
    assert set(named.select("rain").distinct().toPandas().rain) <= {"none", "some", "much"}
    exact = NetworkSampleSource(spark, net, 500, ["grass"], "exact").create()
    assert exact.row_count() == 500 and exact.objectives == ["grass"] and exact.features == ["rain", "season", "slippery", "sprinkler"]
    with pytest.raises(ValueError):
        NetworkSampleSource(spark, net, 5, method="other")


def test_separation_agrees_with_the_textbook_where_children_suffice():
    net = BayesianNetwork.from_edges({"a": ["c"], "b": ["c"], "c": ["d"], "d": ["e"], "e": []})
    assert net.d_separated("a", [], "b") and not net.d_separated("a", ["c"], "b") and not net.d_separated("a", ["d"], "b")
    # a grandchild opens a collider by the textbook rule only
    assert net.d_separated("a", ["e"], "b") and not net.d_separated("a", ["e"], "b", descendants="all")
    g = garden()
    for x, y in itertools.combinations(g.names, 2):
        for k in range(3):
            for z in itertools.combinations([n for n in g.names if n not in (x, y)], k):
                loose, strict = g.d_separated(x, z, y), g.d_separated(x, z, y, descendants="all")
                assert loose == strict or (loose and not strict)


def test_paths(spark):
    net = garden()
    paths = sorted(net.undirected_paths("season", "grass"))
    assert paths == [["season", "rain", "grass"], ["season", "sprinkler", "grass"]]
    assert list(net.directed_paths("grass", "season")) == []
    assert net.distance("season", "slippery") == 4
    frame = path_frame(net.edge_frame(spark), net.number["season"], net.number["grass"])
    assert sorted([net.names[i] for i in r.path] for r in frame.collect()) == paths


def grid(spark):
    rows = [(i, f"row{i}", *[4 * i + j + 1 for j in range(4)], 100 * (i + 1) + 1, 100 * (i + 1) + 2) for i in range(4)]
    return Dataset.of(spark.createDataFrame(rows, "row_id long, row_label string, x0 int, x1 int, x2 int, x3 int, y0 int, y1 int"), ["x0", "x1", "x2", "x3"], ["y0", "y1"], "grid")


def test_dataset_edits(spark, tmp_path):
    d = grid(spark)
    assert d.select_columns([2, 0]).features == ["x0", "x2"] and d.select_columns([1]).objectives == ["y0", "y1"]
    with pytest.raises(ValueError):
        d.select_columns([])
    with pytest.raises(TypeError):
        d.select_columns((1,))
    with pytest.raises(ValueError):
        d.labels("Z")
    with pytest.raises(ValueError):
        d.column_by_label("X", "y0")
    kept = d.keep_rows([3, 1]).df.orderBy("row_id").collect()
    assert [(r.row_id, r.row_label, r.x0) for r in kept] == [(1, "row1", 5), (3, "row3", 13)]  # labels stay with their rows
    assert d.delete_rows([0]).row_count() == 3 and d.delete_columns("Y", 0).objectives == ["y1"]
    assert d.values("X")["x0"] == [1, 5, 9, 13] and d.column_count("Y") == 2
    assert d.equals(grid(spark)) and d.diff(d.delete_columns("X", 1)) == ["features"]
    with pytest.raises(DatasetNotFinalizedError):
        d.save(f"file://{tmp_path}")
    f = d.finalized()
    with pytest.raises(DatasetFinalizedError):
        f.delete_rows([1])
    f.save(f"file://{tmp_path}")
    assert Dataset.load(spark, f"file://{tmp_path}", "grid").equals(d)
    with pytest.raises(UnequalCounts):
        d.joined(d.select_rows([1]))


def test_identity_and_saved_matrices(spark, tmp_path):
    d = IdentitySource(spark, 3).create()
    assert [[r[c] for c in d.features] for r in d.df.orderBy("row_id").collect()] == [[1, 0, 0], [0, 1, 0], [0, 0, 1]]
    p = tmp_path / "m"
    p.mkdir()
    (p / "X.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n%\n2 3 3\n1 1 5\n2 3 7\n1 2 1\n")
    (p / "Y.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n%\n2 1 1\n2 1 1\n")
    for name, lines in (("row_labels", "a\nb"), ("column_labels_X", "p\nq\nr"), ("column_labels_Y", "t")):
        (p / f"{name}.txt").write_text(lines + "\n")
    m = load_dataset(spark, f"file://{tmp_path}", "m")
    assert [tuple(r[c] for c in ("row_label", "p", "q", "r", "t")) for r in m.df.orderBy("row_id").collect()] == [("a", 5, 1, 0, 0), ("b", 0, 0, 7, 1)] and m.final
    assert read_matrix(spark, f"file://{p}/X.mtx")[1] == (2, 3)


def test_synthetic_binary_pruning_and_split(spark):
    source = SyntheticBinarySource(spark, 100, {"b": 0.5, "a": 1.0, "c": 0.03}, {"y": 0.25}, 42)
    d = source.create()
    assert d.features == ["a", "b", "c"] and d.df.agg(*[F.sum(c) for c in ("a", "b", "c", "y")]).first()[:] == (100, 50, 3, 25)
    assert not d.equals(source.create(seed=43)) and d.equals(source.create())
    assert columns_to_remove(d, "X", (0.1, 0.8)) == {0: "a", 2: "c"}
    assert columns_to_remove(d, "X", (0.03, 1.0)) == {}  # bounds stay
    split = SplitDataset.build(d, SplitOptions(0.25, 42, prune_features=True, feature_thresholds={"full": (0.1, 0.8), "train": (0.0, 1.0), "test": (0.0, 1.0)}))
    assert split.full.features == split.train.features == ["b"] and (split.train.row_count(), split.test.row_count()) == (25, 75)
    ids = [{r.row_id for r in split.part(p).df.select("row_id").collect()} for p in ("train", "test")]
    assert not ids[0] & ids[1] and len(ids[0] | ids[1]) == 100
    again = split_rows(d.df.repartition(7), 25, seed=42).where("is_train").select("row_id")
    assert {r.row_id for r in again.collect()} == ids[0]
    with pytest.raises(ValueError):
        split.part("other")


CORPUS = ".I 11\n.W\nred green red\nblue\n\n.I 12\n.W\ngreen\n\n.I 13\n.W\nyellow red\n\n"


def test_doc_term_source(spark, tmp_path):
    (tmp_path / "tokens.dat").write_text(CORPUS)
    (tmp_path / "ids.txt").write_text("13\n11\n12\n")
    (tmp_path / "topics.txt").write_text("T1 11 1\nT2 11 1\nT1 13 1\nT9 99 1\n")
    (tmp_path / "industries.txt").write_text("I1 12 1\nI1 11 1\nI2 13 1\n")
    at = f"file://{tmp_path}"
    assert [r.doc_id for r in read_ids(spark, f"{at}/ids.txt").collect()] == [11, 12, 13]
    source = DocTermSource(read_tokens(spark, f"{at}/tokens.dat"), read_relevance(spark, f"{at}/topics.txt", "topic"), read_relevance(spark, f"{at}/industries.txt", "industry"))
    d = source.create()
    assert d.features == ["blue", "green", "red", "yellow"] and d.objectives == ["T1", "T2"]
    table = [tuple(r[c] for c in ("row_id", *d.features, *d.objectives)) for r in d.df.orderBy("row_id").collect()]
    assert table == [(11, 1, 1, 2, 0, 1, 1), (12, 0, 1, 0, 0, 0, 0), (13, 0, 0, 1, 1, 1, 0)]
    b = source.create(feature_type="binary", filters={"industry": "I1"})
    assert [tuple(r[c] for c in ("row_id", *b.features)) for r in b.df.orderBy("row_id").collect()] == [(11, 1, 1, 1), (12, 0, 1, 0)]
    assert source.create(filters={"industry": "NONE"}).row_count() == 0
    for bad in ({"topic": "x"}, {"industry": "I1", "x": 1}):
        with pytest.raises(ValueError):
            source.create(filters=bad)
    with pytest.raises(ValueError):
        source.create(feature_type="tfidf")


def test_locks_and_runs(spark, tmp_path):
    place = exp.LockablePath(tmp_path, "f")
    place.lock("a")
    assert place.locked() and place.locked("a") and not place.locked("b")
    with pytest.raises(LockedPathError):
        place.delete()
    place.unlock("a")
    place.delete()
    assert not place.exists()
    with pytest.raises(LockedPathError):
        place.delete()

    def pick(data, params):
        return data.features[: params["k"]], {"tp": 1}

    e = exp.Experiment("e", str(tmp_path), lambda: grid(spark), [{"id": "r1", "algorithm": pick, "k": 2, "target": "y0", "tags": ["t"]}, {"algorithm": pick, "k": 1, "skip": True}])
    points = e.run(spark)
    assert [p.boundary for p in points] == [["x0", "x1"]] and "begin r1" in (tmp_path / "e/logs/r1.log").read_text()
    row = spark.read.parquet(f"{tmp_path}/e/datapoints").first()
    assert row.params["algorithm"] == "pick" and row.evaluation == {"tp": 1} and row.duration_s >= 0
    with pytest.raises(ExperimentLockedError):
        e.run(spark)
    assert len(exp.by_tag(e.runs, "t")) == 1 and exp.by_range(range(10), "2-4") == [2, 3, 4] and exp.by_range(range(10), "3") == [3]
    built = []
    for _ in range(2):
        load_or_build(spark, str(tmp_path), "ds", lambda: built.append(1) or grid(spark))
    assert built == [1]


def test_summaries(spark):
    found = spark.createDataFrame([("a", ["b", "c"]), ("b", [])], "target string, boundary array<string>")
    true = spark.createDataFrame([("a", ["b", "d"]), ("b", ["a"])], "target string, boundary array<string>")
    q = {r.target: r for r in exp.boundary_quality(found, true).collect()}
    assert (q["a"].errors, q["a"].precision, q["a"].recall) == (2, 0.5, 0.5) and q["a"].distance == pytest.approx(math.sqrt(0.5)) and q["b"].precision == 0
    assert exp.request_counts(4)["tests"] == 24 and exp.request_counts(4)["reads"][2] == {"xyz": 1, "xz_yz": 4, "z": 1}
    rows = spark.createDataFrame([(1, 1), (0, 0), (0, 1), (1, 0), (1, 0)], "y int, p int")
    assert exp.confusion(rows, "y", "p").first()[:] == (1, 1, 1, 2)


def test_streaming_counts(spark, tmp_path, small):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(stream, "ts", "event_type", window="1 day").writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counts").exceptAll(windowed_counts(events, "ts", "event_type", window="1 day")).isEmpty()
    assert windowed_mi(windowed_counts(events.withColumn("b", F.col("value") > 50), "ts", "event_type", "b"), "event_type", "b").where("mi < -1e-12").isEmpty()


def test_harness(spark):
    from margrave.operators.citest import CITestConfig
    from margrave.plans import harness

    net = garden()
    data = net.sample(spark, 20_000, seed=8).cache()
    rows = {r.algorithm: r for r in harness.accuracy(spark, net, data, CITestConfig(significance=0.99, strategy="cuboid")).collect()}
    assert rows["ipcmb"].recall > 0.8 and rows["ipcmb"].accuracy > 0.8 and rows["iamb"].precision > 0.8
    by = {r["strategy"]: r for r in harness.strategies(data, net.names)}
    assert by["direct"]["tests"] == by["entropy"]["tests"] and by["entropy"]["misses"] < by["entropy"]["reads"]
    stats = harness.cuboid_stats(data, net.names)
    assert stats["rows"] == 20_000 and stats["cells"] <= 48
    assert harness.run_id("ds", "garden", "ipcmb", 3, 40_000) == "ds_garden_4e4_ipcmb_T3" and harness.sample_count("4e4") == 40_000
    with pytest.raises(ValueError):
        harness.sample_count("many")


def test_command_line(spark, tmp_path, capsys, small):
    from margrave.__main__ import main

    main(["folder", "lock", str(tmp_path), "x", "--kind", "a"])
    main(["folder", "list", str(tmp_path)])
    assert capsys.readouterr().out == "x a\n"
    main(["folder", "unlock", str(tmp_path), "x", "--kind", "a"])
    main(["folder", "delete", str(tmp_path), "x"])
    assert not (tmp_path / "x").exists()
    main(["boundary", f"{small}/lineitem.parquet", "--columns", "l_returnflag,l_linestatus,l_linenumber", "--targets", "l_returnflag"])
    assert capsys.readouterr().out.startswith('{"l_returnflag": [')

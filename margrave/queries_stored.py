"""More queries: sources and sinks read back from files, tests from stored counts, plug points, records; with equivalent SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from margrave import experiment as exp
from margrave.dataset import Dataset, SplitDataset, SplitOptions, columns_to_remove, load_or_build
from margrave.operators import counts as ct
from margrave.operators.citest import CITestConfig, CITester, Request, all_requests, load_dofs, load_entropies
from margrave.operators.cuboids import CuboidCache
from margrave.plans.boundary import cmi_heuristic, iamb, network_cmi_heuristic
from margrave.plans.harness import grid, run_grid
from margrave.queries import (
    BATCH, BINARY, CATEGORIES, FLAGS, GARDEN, JOINT, ONE, TRUE, WORDS, _binary, _cells, _factors_sql, _mi_sql, _nations, _tested, garden, g_sql, query, rounded, table,
)
from margrave.sources.bif import read_bif
from margrave.sources.bn_sample import NetworkSampleSource
from margrave.sources.doc_term import DocTermSource, read_ids, read_relevance, read_tokens
from margrave.sources.matrix_market import load_dataset
from margrave.storage import shared_folder
from margrave.streaming.contingency import windowed_counts, windowed_mi


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/query-{uuid.uuid4().hex}"


def _lines(df: DataFrame, path: str) -> str:
    df.coalesce(1).write.text(path)
    return path


# Sources.


@query("SELECT c_custkey AS doc_id FROM customer")
def ids_file(spark, d):
    lines = table(spark, d, "customer").select(F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit("  ")).alias("value"))
    return read_ids(spark, _lines(lines, _folder(spark)))


@query("SELECT c_mktsegment AS topic, c_custkey AS doc_id FROM customer")
def relevance_file(spark, d):
    lines = table(spark, d, "customer").select(F.concat_ws(" ", "c_mktsegment", F.col("c_custkey").cast("string"), F.lit("1")).alias("value"))
    return read_relevance(spark, _lines(lines, _folder(spark)), "topic")


@query("SELECT s_suppkey AS doc_id, 'word ' || s_name || ' ' || s_suppkey AS text FROM supplier")
def token_files(spark, d):
    lines = table(spark, d, "supplier").select(F.concat(F.lit(".I "), F.col("s_suppkey").cast("string"), F.lit("\n.W\nword "), F.col("s_name"), F.lit("\n"), F.col("s_suppkey").cast("string"), F.lit("\n")).alias("value"))
    tokens = read_tokens(spark, _lines(lines, _folder(spark)))
    return tokens.select("doc_id", F.regexp_replace(F.trim(F.regexp_replace("text", r"\s+$", "")), r"\s+", " ").alias("text"))


def _named(spark, d) -> DocTermSource:
    nations = table(spark, d, "nation")
    docs = nations.select(F.col("n_nationkey").cast("long").alias("doc_id"), F.concat_ws(" ", "n_name", F.lit("land"), F.lit("land")).alias("text"))
    topics = nations.select(F.concat(F.lit("region"), F.col("n_regionkey").cast("string")).alias("topic"), F.col("n_nationkey").cast("long").alias("doc_id"))
    return DocTermSource(docs, topics, topics.withColumnRenamed("topic", "industry"))


def _cells_of(data: Dataset, cols: list[str], name: str) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.col(f"`{c}`").cast("long").alias("n")) for c in cols]))
    return data.df.select(F.col("row_id").alias("doc_id"), each.alias("s")).select("doc_id", "s.*")


NAMED = f"(SELECT CAST(n_nationkey AS BIGINT) AS doc_id, n_name || ' land land' AS text FROM nation)"


@query(
    f"""WITH w AS (SELECT doc_id, unnest({WORDS}) AS word FROM {NAMED})
SELECT d.doc_id, v.word, count(w.word) AS n FROM {NAMED} d CROSS JOIN (SELECT DISTINCT word FROM w) v LEFT JOIN w ON w.doc_id = d.doc_id AND w.word = v.word GROUP BY ALL"""
)
def doc_term_pivot(spark, d):
    data = _named(spark, d).create()
    return _cells_of(data, data.features, "word")


@query("SELECT CAST(a.n_nationkey AS BIGINT) AS doc_id, 'region' || r.k AS topic, CAST(a.n_regionkey = r.k AS BIGINT) AS n FROM nation a, (SELECT 3 AS k) r WHERE a.n_regionkey = 3")
def doc_topic_pivot_of_an_industry(spark, d):
    data = _named(spark, d).create(feature_type="binary", filters={"industry": "region3"})
    return _cells_of(data, data.objectives, "topic")


BIF_CELLS = [
    ("grass", "off,none", (0.95, 0.05)), ("grass", "off,some", (0.3, 0.7)), ("grass", "off,much", (0.05, 0.95)),
    ("grass", "on,none", (0.1, 0.9)), ("grass", "on,some", (0.05, 0.95)), ("grass", "on,much", (0.01, 0.99)),
    ("rain", "dry", (0.7, 0.2, 0.1)), ("rain", "wet", (0.2, 0.5, 0.3)), ("season", "", (0.6, 0.4)),
    ("slippery", "dry", (0.97, 0.03)), ("slippery", "wet", (0.4, 0.6)), ("sprinkler", "dry", (0.3, 0.7)), ("sprinkler", "wet", (0.85, 0.15)),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{k}', {i}, CAST({p} AS DOUBLE))" for n, k, ps in BIF_CELLS for i, p in enumerate(ps)) + ") v(node, given, value_idx, p)")
def bif_file(spark, d):
    path = _lines(spark.createDataFrame([(GARDEN,)], "value string"), _folder(spark))
    net = read_bif(path, spark).finalize()
    names = F.array(*[F.lit(n) for n in net.names])
    return net.cpt_frame(spark).select(names[F.col("node")].alias("node"), F.array_join("parent_values", ",").alias("given"), "value_idx", "p")


EDGES = "(VALUES ('season', 'sprinkler'), ('season', 'rain'), ('sprinkler', 'grass'), ('rain', 'grass'), ('grass', 'slippery')) e(parent, child)"


@query(f"SELECT parent, child, true AS before FROM {EDGES}")
def bn_sampling_order(spark, d):
    """Every node is sampled after its parents."""
    net = garden()
    place = {n: i for i, n in enumerate(net.order)}
    return spark.createDataFrame([(p, n, place[p] < place[n]) for n in net.names for p in net.nodes[n].parents], "parent string, child string, before boolean")


@query(_factors_sql() + "SELECT count(*) AS cells, CAST(10000 * round(sum(p), 9) AS BIGINT) AS mass FROM j")
def bn_joint_size(spark, d):
    net = garden()
    mass = net.joint(spark).agg(F.sum("p")).first()[0]
    return spark.createDataFrame([(net.joint_size(), round(10000 * round(mass, 9)))], "cells long, mass long")


@query(_factors_sql() + "SELECT rain, grass, true AS near FROM j GROUP BY ALL")
def bn_samples_near_joint(spark, d):
    """Shares of 50,000 random samples are within 0.01 of the joint distribution, cell by cell."""
    net = garden()
    seen = ct.pmf(net.sample(spark, 50_000, seed=5, indices=False), "rain", "grass").withColumnRenamed("p", "seen")
    both = net.partial_joint(spark, ["rain", "grass"]).join(seen, ["rain", "grass"], "full")
    return both.select("rain", "grass", (F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("seen", F.lit(0.0))) < 0.01).alias("near"))


@query(
    _factors_sql()
    + """, k AS (SELECT *, row_number() OVER (ORDER BY p DESC, grass, rain, season, slippery, sprinkler) AS r, greatest(1, CAST(round_even(400 * p, 0) AS INT)) AS w FROM j WHERE p > 0),
b AS (SELECT *, coalesce(sum(w) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k),
c AS (SELECT list_position(['dry', 'wet'], grass) - 1 AS grass, list_position(['none', 'some', 'much'], rain) - 1 AS rain, list_position(['no', 'yes'], slippery) - 1 AS slippery, greatest(least(w, 400 - before), 0) AS n FROM b WHERE before < 400)
SELECT CAST(grass AS INT) AS grass, CAST(rain AS INT) AS rain, CAST(slippery AS INT) AS slippery, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1, 2, 3"""
)
def bn_exact_source(spark, d):
    data = NetworkSampleSource(spark, garden(), 400, ["grass", "slippery"], "exact").create().df
    return ct.value_counts(data.select(*[F.col(c).cast("int").alias(c) for c in ("grass", "rain", "slippery")]), "grass", "rain", "slippery")


@query("SELECT CAST(n_nationkey AS BIGINT) AS row_id, n_name AS row_label, " + ", ".join(f"CAST(n_regionkey = {i} AS INT) AS r{i}" for i in range(5)) + ", CAST(n_nationkey % 7 AS INT) AS y FROM nation")
def matrix_files(spark, d):
    folder, nations = _folder(spark), table(spark, d, "nation").orderBy("n_nationkey").coalesce(1)
    head = lambda rows, cols: spark.createDataFrame([("%%MatrixMarket matrix coordinate integer general",), (f"{rows} {cols} 25",)], "value string")
    cells = {"X": "concat_ws(' ', n_nationkey + 1, n_regionkey + 1, 1)", "Y": "concat_ws(' ', n_nationkey + 1, 1, n_nationkey % 7)"}
    for m, cols in (("X", [f"r{i}" for i in range(5)]), ("Y", ["y"])):
        _lines(head(25, len(cols)).coalesce(1).unionByName(nations.selectExpr(f"{cells[m]} as value")).coalesce(1), f"{folder}/m/{m}.mtx")
        _lines(spark.createDataFrame([(c,) for c in cols], "value string"), f"{folder}/m/column_labels_{m}.txt")
    _lines(nations.select(F.col("n_name").alias("value")), f"{folder}/m/row_labels.txt")
    return load_dataset(spark, folder, "m").df


# Datasets.


@query("SELECT n_nationkey AS row_id, n_name, n_regionkey FROM nation")
def saved_dataset(spark, d):
    folder = _folder(spark)
    _nations(spark, d).finalized().save(folder)
    return Dataset.load(spark, folder, "dataset").df


@query("SELECT n_nationkey AS row_id, n_name, n_regionkey, 1 AS built FROM nation")
def loaded_or_built(spark, d):
    """Built once, saved and locked; loaded the second time."""
    folder, built = _folder(spark), []

    def build():
        built.append(1)
        return _nations(spark, d)

    load_or_build(spark, folder, "nations", build)
    return load_or_build(spark, folder, "nations", build).df.withColumn("built", F.lit(len(built)))


@query("SELECT 'full' AS part, count(*) AS n FROM customer UNION ALL SELECT 'train', CAST(floor(count(*) * 0.25) AS BIGINT) FROM customer UNION ALL SELECT 'test', count(*) - CAST(floor(count(*) * 0.25) AS BIGINT) FROM customer")
def saved_split(spark, d):
    folder = _folder(spark)
    data = Dataset.of(table(spark, d, "customer").withColumnRenamed("c_custkey", "row_id"), ["c_mktsegment"], label="customers")
    SplitDataset.build(data, SplitOptions(0.25, 42)).save(folder)
    split = SplitDataset.load(spark, folder, "customers")
    return spark.createDataFrame([(p, split.part(p).row_count()) for p in ("full", "train", "test")], "part string, n long")


@query("SELECT n_regionkey FROM nation")
def column_by_number(spark, d):
    return _nations(spark, d).column("X", 1)


@query("SELECT n_name || ':' || n_regionkey AS both FROM nation")
def joint_variable(spark, d):
    data = _nations(spark, d)
    return data.df.select(data.variables("X", [0, 1]).alias("v")).select(F.concat_ws(":", "v.n_name", F.col("v.n_regionkey").cast("string")).alias("both"))


@query("SELECT count(*) AS n_rows, 2 AS n_columns, count(DISTINCT n_regionkey) AS n_regions FROM nation")
def dataset_info(spark, d):
    data = _nations(spark, d)
    return spark.createDataFrame([(data.info()["rows"], data.info()["X"], len(data.values()["n_regionkey"]))], "n_rows long, n_columns int, n_regions long")


@query("SELECT n_nationkey AS row_id, n_name, n_regionkey FROM nation WHERE n_nationkey IN (2, 9, 11)")
def keep_rows(spark, d):
    return _nations(spark, d).keep_rows([11, 2, 9]).df


@query("SELECT n_nationkey AS row_id, n_name, n_regionkey, n_nationkey * 2 AS twice FROM nation")
def joined_datasets(spark, d):
    nations = _nations(spark, d)
    twice = Dataset.of(nations.df.select("row_id", (F.col("row_id") * 2).alias("twice")), ["twice"])
    return nations.joined(twice).df


@query(
    "SELECT col FROM (SELECT 'r' AS col, avg(r) AS m FROM " + BINARY + " UNION ALL SELECT 'f', avg(f) FROM " + BINARY + " UNION ALL SELECT 'q', avg(q) FROM " + BINARY + " UNION ALL SELECT 't', avg(t) FROM " + BINARY + ") WHERE m < 0.45 OR m > 0.55"
)
def threshold_prune_some(spark, d):
    gone = columns_to_remove(Dataset.of(_binary(spark, d)), "X", (0.45, 0.55))
    return spark.createDataFrame([(c,) for c in gone.values()], "col string")


# Tests and their stores.


def _tester(spark, d, **config) -> CITester:
    return CITester(table(spark, d, "lineitem", *CATEGORIES), CATEGORIES, CITestConfig(**config))


@query(g_sql(*ONE))
def ci_results_file(spark, d):
    folder = _folder(spark)
    tester = _tester(spark, d, strategy="cuboid", results_path=folder)
    tester.batch([Request.of(*ONE)])
    tester.end()
    df = spark.read.parquet(folder)
    return df.select("x", "y", F.array_join("z", ",").alias("z"), F.round("g", 6).alias("g"), "dof", "n", F.round("p", 6).alias("p"), "insufficient", "independent")


@query(" UNION ALL ".join(f"(SELECT x, y, z, g AS g_left, g AS g_right, dof FROM ({g_sql(*r)}))" for r in BATCH[:12]))
def g_test_strategies_side_by_side(spark, d):
    frames = []
    for s in ("cuboid", "entropy"):
        tester = _tester(spark, d, strategy=s)
        tester.batch([Request.of(*r) for r in BATCH[:12]])
        frames.append(tester.frame())
    a, b = (f.select("idx", "x", "y", F.array_join("z", ",").alias("z"), F.round("g", 6).alias("g"), "dof") for f in frames)
    return a.withColumnRenamed("g", "g_left").join(b.select("idx", F.col("g").alias("g_right"), F.col("dof").alias("dof2")), "idx").where("dof = dof2").drop("idx", "dof2")


@query(g_sql(*ONE))
def g_test_preloaded_cuboid(spark, d):
    """Rolled up from a cuboid stored ahead: no pass over the samples for the test."""
    cache = CuboidCache(table(spark, d, "lineitem", *CATEGORIES), CATEGORIES)
    cache.build([("l_linenumber", "l_linestatus", "l_returnflag", "l_tax")])
    tester = _tester(spark, d, strategy="direct", cuboids=cache)
    tester.batch([Request.of(*ONE)])
    return _tested(tester).where(F.lit(tester.counter.scans == 0))


@query(g_sql(*ONE).replace("5 * dof < n", "100000000 * dof < n"))
def g_test_sufficiency(spark, d):
    tester = _tester(spark, d, sufficient=lambda n, dof: 100_000_000 * dof < n)
    tester.batch([Request.of(*ONE)])
    return _tested(tester)


@query(g_sql(*ONE).replace("(SELECT greatest(1, CAST(sum(v) AS BIGINT))", "(SELECT 3 + greatest(1, CAST(sum(v) AS BIGINT))"))
def g_test_own_dof(spark, d):
    tester = _tester(spark, d, dof=lambda tester, q, structural: structural + 3)
    tester.batch([Request.of(*ONE)])
    return _tested(tester)


def _entropy_of(s: tuple[str, ...]) -> str:
    return f"SELECT '{','.join(sorted(s))}' AS vars, round(-sum(p * ln(p)), 9) AS h FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM lineitem GROUP BY {', '.join(s)})"


@query(" UNION ALL ".join(_entropy_of(s) for s in (("l_linenumber", "l_linestatus", "l_returnflag"), ("l_linestatus", "l_returnflag"), ("l_linenumber", "l_linestatus"), ("l_linestatus",))))
def entropy_file(spark, d):
    folder = _folder(spark)
    tester = _tester(spark, d, strategy="entropy", entropy_path=folder)
    tester.batch([Request.of(*ONE)])
    tester.end()
    return rounded(spark.createDataFrame([(",".join(sorted(k)), v) for k, v in load_entropies(spark, folder).items() if k], "vars string, h double"))


@query("SELECT 'l_linenumber' AS x, 'l_returnflag' AS y, greatest(1, CAST(sum(v) AS BIGINT)) AS dof FROM (SELECT (count(DISTINCT l_returnflag) - 1) * (count(DISTINCT l_linenumber) - 1) AS v FROM lineitem GROUP BY l_linestatus)")
def dof_file(spark, d):
    folder = _folder(spark)
    tester = _tester(spark, d, strategy="entropy", dof_path=folder)
    tester.batch([Request.of(*ONE)])
    tester.end()
    return spark.createDataFrame([(*sorted(p), v) for (p, _), v in load_dofs(spark, folder).items()], "x string, y string, dof long")


@query(f"SELECT l_returnflag, l_linestatus, n, round(p, 9) AS p FROM ({JOINT})")
def cuboid_files(spark, d):
    folder, li = _folder(spark), table(spark, d, "lineitem", *CATEGORIES)
    cache = CuboidCache(li, CATEGORIES, path=folder)
    cache.build([CATEGORIES[:3]])
    cache.save_catalogue()
    again = CuboidCache.load(spark, li, CATEGORIES, folder)
    return rounded(again.pmf(*FLAGS)).where(F.lit(again.scans == 0))


MASKS = " UNION ALL ".join(
    f"SELECT '{x}' AS x, '{y}' AS y, array_to_string(list_filter([" + ", ".join(f"CASE WHEN (m >> {i}) & 1 = 1 THEN '{c}' END" for i, c in enumerate(z for z in sorted(CATEGORIES) if z not in (x, y))) + "], lambda c: c IS NOT NULL), ',') AS z FROM range(0, 8) r(m)"
    for k, x in enumerate(sorted(CATEGORIES)) for y in sorted(CATEGORIES)[k + 1 :]
)


@query(MASKS)
def every_request(spark, d):
    return spark.createDataFrame([(q.x, q.y, ",".join(q.z)) for q in all_requests(CATEGORIES)], "x string, y string, z string")


def _cmi_sql(x: str, y: str, z: tuple[str, ...]) -> str:
    return f"SELECT round(abs(sum(n / t * ln(n * nz / (nxz * nyz)))), 9) AS value FROM ({_cells(x, y, z)})"


OTHERS = ("l_discount", "l_linenumber", "l_tax")


@query(" UNION ALL ".join(f"SELECT '{c}' AS y, value FROM ({_cmi_sql('l_returnflag', c, ('l_linestatus',))})" for c in OTHERS))
def cmi_scores(spark, d):
    score = cmi_heuristic(_tester(spark, d))
    return rounded(spark.createDataFrame(list(zip(OTHERS, score([Request.of("l_returnflag", c, ["l_linestatus"]) for c in OTHERS]))), "y string, value double"))


@query(" UNION ALL ".join(f"SELECT 'l_returnflag' AS x, '{c}' AS y, '' AS z, round(mi, 9) AS value FROM ({_mi_sql(c, 'l_returnflag', 'ln')})" for c in CATEGORIES if c != "l_returnflag"))
def heuristic_results_file(spark, d):
    """The first step of a search: every candidate's score given nothing, as it was stored."""
    folder = _folder(spark)
    tester = _tester(spark, d, heuristic_results_path=folder)
    iamb(tester, "l_returnflag")
    tester.end()
    df = spark.read.parquet(folder).where("size(z) = 0 and heuristic = 'cmi'")
    return rounded(df.select("x", "y", F.array_join("z", ",").alias("z"), "value"))


@query(
    _factors_sql()
    + ", "
    + ", ".join(f"c_{y} AS (SELECT '{y}' AS y, season, grass, {y} AS v, sum(p) AS p FROM j GROUP BY ALL)" for y in ("rain", "sprinkler"))
    + ", c AS (SELECT * FROM c_rain UNION ALL SELECT * FROM c_sprinkler) "
    + "SELECT y, round(abs(sum(p * ln(p * pz / (px * py)))), 9) AS value FROM (SELECT y, p, sum(p) OVER (PARTITION BY y, season) AS pz, sum(p) OVER (PARTITION BY y, season, grass) AS px, sum(p) OVER (PARTITION BY y, season, v) AS py FROM c) GROUP BY y"
)
def network_cmi_scores(spark, d):
    ys = ["rain", "sprinkler"]
    values = network_cmi_heuristic(garden(), spark)([Request.of("grass", y, ["season"]) for y in ys])
    return rounded(spark.createDataFrame(list(zip(ys, values)), "y string, value double"))


@query(
    f"SELECT count(*) AS tests, round(avg(k), 9) AS mean_size, CAST(max(n) AS BIGINT) AS most FROM (SELECT k, count(*) OVER (PARTITION BY k) AS n FROM (VALUES {', '.join(f'({len(z)})' for *_, z in BATCH)}) v(k))"
)
def ci_summary_of_tests(spark, d):
    tester = _tester(spark, d, strategy="cuboid")
    tester.batch([Request.of(*r) for r in BATCH])
    most = exp.conditioning_sizes(tester.frame()).agg(F.max("n").alias("most"))
    return rounded(exp.test_summary(tester.frame()).select("tests", "mean_size").crossJoin(F.broadcast(most)))


# Experiments.


@query(f"SELECT target, boundary, 1 AS runs, true AS locked FROM ({TRUE}) WHERE target IN ('rain', 'slippery')")
def experiment_datapoints(spark, d):
    from margrave.plans.boundary import ipcmb

    def discover(data, params):
        net = garden()
        return ipcmb(CITester(spark.range(1), net.names, CITestConfig(strategy="dsep", network=net)), params["target"])

    runs = [{"algorithm": discover, "target": t, "tags": [t[:1]]} for t in ("rain", "slippery")] + [{"algorithm": discover, "target": "grass", "skip": True}]
    folder = shared_folder(spark).removeprefix("file:")
    e = exp.Experiment(f"e-{uuid.uuid4().hex}", folder.replace("//", "/") if folder.startswith("//") else folder, lambda: _nations(spark, d), runs)
    e.run(spark)
    points = spark.read.parquet(f"{e.folder().url}/datapoints")
    runs_of = points.groupBy("target").agg(F.count("*").cast("int").alias("runs"), F.first(F.array_join("boundary", ",")).alias("boundary"))
    return runs_of.select("target", "boundary", "runs", F.lit(e.folder().locked("experiment")).alias("locked"))


@query("SELECT tag, target, boundary FROM (" + TRUE + ") b, (VALUES ('unoptimized'), ('dynamic_10'), ('static_10'), ('entropy'), ('dsep')) t(tag)")
def strategy_grid(spark, d):
    """The families of the comparison of caches find the same boundaries, here the true ones."""
    net = garden()
    data = net.exact_samples(spark, 40_000).drop("row_id")
    runs = [r for r in grid(data, net.names, net, 0.99) if r["tag"] in ("unoptimized", "dynamic_10", "static_10", "entropy", "dsep")]
    rows = [(r["tag"], t, ",".join(m)) for r in run_grid(data, net.names, runs) for t, m in r["boundaries"].items()]
    return spark.createDataFrame(rows, "tag string, target string, boundary string")


NB = f"(SELECT l_orderkey % 2 = 0 AS train, CAST(l_returnflag = 'R' AS INT) AS r, CAST(l_linestatus = 'F' AS INT) AS f, CAST(l_quantity > 25 AS INT) AS q, CAST(l_tax > 0.04 AS INT) AS t FROM lineitem)"


@query(
    f"""WITH a AS (SELECT * FROM {NB}),
c AS (SELECT r AS k, count(*) AS n, sum(f) AS f, sum(q) AS q, sum(t) AS t FROM a WHERE train GROUP BY r),
m AS (SELECT k, ln(n + 1) - ln((SELECT sum(n) + 2 FROM c)) AS prior, ln(f + 1) - ln(n + 2) AS f1, ln(n - f + 1) - ln(n + 2) AS f0, ln(q + 1) - ln(n + 2) AS q1, ln(n - q + 1) - ln(n + 2) AS q0, ln(t + 1) - ln(n + 2) AS t1, ln(n - t + 1) - ln(n + 2) AS t0 FROM c),
s AS (SELECT a.r, a.f, a.q, a.t, m.k, prior + CASE WHEN a.f = 1 THEN f1 ELSE f0 END + CASE WHEN a.q = 1 THEN q1 ELSE q0 END + CASE WHEN a.t = 1 THEN t1 ELSE t0 END AS score FROM (SELECT DISTINCT f, q, t FROM a) x, m, a WHERE NOT a.train AND a.f = x.f AND a.q = x.q AND a.t = x.t),
p AS (SELECT f, q, t, arg_max(k, score) AS guess FROM s GROUP BY ALL)
SELECT count(*) FILTER (r = 1 AND guess = 1) AS tp, count(*) FILTER (r <> 1 AND guess <> 1) AS tn, count(*) FILTER (r <> 1 AND guess = 1) AS fp, count(*) FILTER (r = 1 AND guess <> 1) AS fn
FROM a JOIN p USING (f, q, t) WHERE NOT train"""
)
def naive_bayes_on_given_parts(spark, d):
    li = table(spark, d, "lineitem")
    flags = [(F.col("l_returnflag") == "R").cast("int").alias("r"), (F.col("l_linestatus") == "F").cast("int").alias("f"), (F.col("l_quantity") > 25).cast("int").alias("q"), (F.col("l_tax") > 0.04).cast("int").alias("t")]
    part = lambda even: Dataset.of(li.where(f"l_orderkey % 2 {'=' if even else '<>'} 0").select(*flags), ["f", "q", "t"], ["r"])
    return exp.classify(SplitDataset(part(True), part(True), part(False)), ["f", "q", "t"], "r")


@query(
    """SELECT start, round(sum(n / t * ln(n * t / (nx * ny))), 9) AS mi FROM (
SELECT start, n, sum(n) OVER (PARTITION BY start, event_type) AS nx, sum(n) OVER (PARTITION BY start, large) AS ny, sum(n) OVER (PARTITION BY start) AS t
FROM (SELECT date_trunc('day', ts) AS start, event_type, value > 50 AS large, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY ALL)) GROUP BY start"""
)
def windowed_mutual_information(spark, d):
    events = table(spark, d, "events").withColumn("large", F.col("value") > 50)
    mi = windowed_mi(windowed_counts(events, "ts", "event_type", "large"), "event_type", "large")
    return rounded(mi.withColumn("start", F.col("start").cast("timestamp_ntz")))

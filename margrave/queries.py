"""Queries over the test tables, one or more for each operator, with equivalent SQL."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from margrave import experiment as exp
from margrave.dataset import Dataset, SplitDataset, SplitOptions, columns_to_remove, numbered, split_rows
from margrave.functions.info import chi2_cdf
from margrave.operators import counts as ct
from margrave.operators import information as inf
from margrave.operators.bayesnet import path_frame
from margrave.operators.citest import CITestConfig, CITester, Request, disagreements
from margrave.operators.cuboids import CuboidCache
from margrave.plans.boundary import iamb, information_gain_ranking, ipcmb, ipcmb_all, pcmb
from margrave.sources.base import IdentitySource
from margrave.sources.bif import parse_bif
from margrave.sources.bn_sample import NetworkSampleSource
from margrave.sources.doc_term import DocTermSource, ids_in_industry, vocabulary, word_counts
from margrave.sources.synthetic_binary import SyntheticBinarySource, share_of_ones
from margrave.streaming.contingency import windowed_counts, windowed_mi

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


FLAGS = ("l_returnflag", "l_linestatus")
CATEGORIES = ("l_returnflag", "l_linestatus", "l_linenumber", "l_tax", "l_discount")

# Frequency tables.


@query("SELECT l_returnflag, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS p FROM lineitem GROUP BY 1")
def pmf_single(spark, d):
    return rounded(ct.pmf(table(spark, d, "lineitem"), "l_returnflag"))


JOINT = "SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) / sum(count(*)) OVER () AS p FROM lineitem GROUP BY 1, 2"


@query(f"SELECT l_returnflag, l_linestatus, n, round(p, 9) AS p FROM ({JOINT})")
def pmf_joint(spark, d):
    return rounded(ct.pmf(table(spark, d, "lineitem"), *FLAGS))


@query(f"SELECT l_returnflag, CAST(sum(n) AS BIGINT) AS n, round(sum(p), 9) AS p FROM ({JOINT}) GROUP BY 1")
def pmf_marginalize(spark, d):
    return rounded(ct.marginalize(ct.pmf(table(spark, d, "lineitem"), *FLAGS), "l_linestatus"))


@query(f"SELECT l_returnflag, l_linestatus, n, round(p, 9) AS p, round(p / sum(p) OVER (PARTITION BY l_returnflag), 9) AS p_cond FROM ({JOINT})")
def pmf_condition_on(spark, d):
    return rounded(ct.condition_on(ct.pmf(table(spark, d, "lineitem"), *FLAGS), "l_returnflag"))


@query("SELECT l_linestatus, l_tax, l_returnflag, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY l_linestatus, l_tax), 9) AS p_cond FROM lineitem GROUP BY 1, 2, 3")
def cpmf_given(spark, d):
    return rounded(ct.conditional_pmf(table(spark, d, "lineitem"), ["l_returnflag"], ["l_linestatus", "l_tax"]))


@query("SELECT l_returnflag, round(count(*) / sum(count(*)) OVER (), 9) AS p FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1")
def cpmf_lookup(spark, d):
    return rounded(ct.given(ct.conditional_pmf(table(spark, d, "lineitem"), ["l_returnflag"], ["l_linestatus"]), l_linestatus="O"))


@query("SELECT l_returnflag, l_linestatus, count(*) * 2 AS n, round(count(*) / sum(count(*)) OVER (), 9) AS p FROM lineitem GROUP BY 1, 2")
def pmf_add_counts(spark, d):
    counts = ct.value_counts(table(spark, d, "lineitem"), *FLAGS)
    return rounded(ct.add_counts(counts, counts))


@query("SELECT 1 AS one, round(sum(p * ln(p)), 9) AS value FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM lineitem GROUP BY l_discount)")
def pmf_expected_value(spark, d):
    value = ct.expected_value(ct.pmf(table(spark, d, "lineitem"), "l_discount"), lambda _, p: F.ln(p))
    return spark.createDataFrame([(1, round(value, 9))], "one int, value double")


@query("SELECT CAST(round_even(1 / min(p), 0) AS BIGINT) AS samples FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM lineitem GROUP BY l_returnflag, l_tax)")
def pmf_min_sample_size(spark, d):
    return spark.createDataFrame([(ct.min_sample_size(ct.pmf(table(spark, d, "lineitem"), "l_returnflag", "l_tax")),)], "samples long")


@query("SELECT l_linestatus, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) <> 0")
def pmf_remove_zeros(spark, d):
    return ct.remove_zeros(ct.contingency(table(spark, d, "lineitem"), ["l_linestatus"], zeros={"l_linestatus": ["F", "O", "X"]}))


@query(
    """WITH a AS (SELECT l_returnflag, count(*) / sum(count(*)) OVER () AS p FROM lineitem GROUP BY 1),
b AS (SELECT l_returnflag, count(*) / sum(count(*)) OVER () AS p FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
SELECT coalesce(a.l_returnflag, b.l_returnflag) AS l_returnflag, round(a.p, 9) AS p_left, round(b.p, 9) AS p_right
FROM a FULL JOIN b ON a.l_returnflag = b.l_returnflag WHERE a.p IS NULL OR b.p IS NULL OR abs(a.p - b.p) > 1e-10"""
)
def pmf_difference(spark, d):
    li = table(spark, d, "lineitem")
    return rounded(ct.pmf_diff(ct.pmf(li, "l_returnflag"), ct.pmf(li.where("l_linestatus = 'F'"), "l_returnflag")))


@query("SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 2 AND l_tax = 0.03")
def conjunctive_count(spark, d):
    return ct.value_counts(table(spark, d, "lineitem").where(ct._matches({"l_returnflag": "R", "l_linenumber": 2, "l_tax": 0.03})))


@query("SELECT round(count(*) FILTER (l_linestatus = 'F' AND l_returnflag = 'R') / count(*) FILTER (l_linestatus = 'F'), 9) AS p FROM lineitem")
def conditional_probability(spark, d):
    return spark.createDataFrame([(round(ct.query(table(spark, d, "lineitem"), {"l_returnflag": "R"}, {"l_linestatus": "F"}), 9),)], "p double")


@query(
    """SELECT f.l_returnflag, s.l_linestatus, l.l_linenumber, coalesce(n, 0) AS n
FROM (SELECT DISTINCT l_returnflag FROM lineitem) f, (SELECT DISTINCT l_linestatus FROM lineitem) s, (SELECT DISTINCT l_linenumber FROM lineitem) l
LEFT JOIN (SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) c
ON c.l_returnflag = f.l_returnflag AND c.l_linestatus = s.l_linestatus AND c.l_linenumber = l.l_linenumber"""
)
def contingency_with_zeros(spark, d):
    return ct.contingency(table(spark, d, "lineitem"), [*FLAGS, "l_linenumber"], zeros=True)


@query("SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL")
def contingency_table(spark, d):
    return ct.contingency(table(spark, d, "lineitem"), ["l_returnflag", "l_linenumber"])


@query(
    " UNION ALL ".join(
        f"(SELECT '{c}' AS col, {v} AS value, n FROM (SELECT {c}, count(*) AS n FROM {t} GROUP BY 1) ORDER BY n DESC, {c} LIMIT 1)"
        for c, v, t in (("l_returnflag", "l_returnflag", "lineitem"), ("l_linenumber", "CAST(l_linenumber AS VARCHAR)", "lineitem"), ("l_linestatus", "l_linestatus", "lineitem"))
    )
)
def most_common_value(spark, d):
    return ct.most_common_value(table(spark, d, "lineitem"), "l_returnflag", "l_linenumber", "l_linestatus")


@query(
    """SELECT 'l_returnflag' AS col, l_returnflag AS value, CAST(row_number() OVER (ORDER BY l_returnflag) - 1 AS INT) AS rank FROM (SELECT DISTINCT l_returnflag FROM lineitem)
UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), CAST(row_number() OVER (ORDER BY l_linenumber) - 1 AS INT) FROM (SELECT DISTINCT l_linenumber FROM lineitem)"""
)
def domains(spark, d):
    return ct.domains(table(spark, d, "lineitem"), "l_returnflag", "l_linenumber")


@query("SELECT l_linestatus, l_returnflag, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS p FROM lineitem GROUP BY 1, 2")
def cuboid_rollup_pmf(spark, d):
    cache = CuboidCache(table(spark, d, "lineitem", *CATEGORIES), CATEGORIES)
    cache.build([CATEGORIES[:4]])
    return rounded(cache.pmf(*FLAGS))


@query("SELECT count(*) FILTER (l_returnflag = 'A' AND l_linenumber = 1) AS n, round(count(*) FILTER (l_returnflag = 'A' AND l_linenumber = 1) / count(*) FILTER (l_linenumber = 1), 9) AS p FROM lineitem")
def cuboid_query(spark, d):
    cache = CuboidCache(table(spark, d, "lineitem", *CATEGORIES), CATEGORIES)
    both = {"l_returnflag": "A", "l_linenumber": 1}
    return spark.createDataFrame([(cache.query_count(both), round(cache.query({"l_returnflag": "A"}, {"l_linenumber": 1}), 9))], "n long, p double")


# Algebra of contingency tables.


@query("SELECT 'all' AS stratum, l_returnflag, count(*) AS n FROM lineitem GROUP BY 2")
def table_prepend_constant(spark, d):
    return ct.append_constant(ct.value_counts(table(spark, d, "lineitem"), "l_returnflag"), "stratum", "all", 0)


@query("SELECT l_linestatus, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1")
def table_drop_leftmost(spark, d):
    return ct.drop_leftmost(ct.value_counts(table(spark, d, "lineitem").where("l_returnflag = 'N'"), *FLAGS))


@query("SELECT l_linestatus, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL")
def table_reorder(spark, d):
    return ct.reorder(ct.value_counts(table(spark, d, "lineitem"), *FLAGS), "l_linestatus", "l_returnflag")


@query("SELECT l_linenumber, CASE WHEN l_linenumber <= 3 THEN count(*) FILTER (l_returnflag = 'R') ELSE count(*) END AS n FROM lineitem GROUP BY 1")
def table_union(spark, d):
    li = table(spark, d, "lineitem")
    return ct.union_tables(ct.value_counts(li, "l_linenumber"), ct.value_counts(li.where("l_returnflag = 'R' and l_linenumber <= 3"), "l_linenumber"))


@query("SELECT l_linenumber, count(*) - count(*) FILTER (l_returnflag = 'R') AS n FROM lineitem GROUP BY 1")
def table_deduct(spark, d):
    li = table(spark, d, "lineitem")
    return ct.combine(ct.value_counts(li, "l_linenumber"), ct.value_counts(li.where("l_returnflag = 'R'"), "l_linenumber"), -1)


@query("SELECT l_linenumber, count(*) + count(*) FILTER (l_returnflag = 'R') AS n FROM lineitem WHERE l_linenumber < 5 GROUP BY 1")
def table_sum(spark, d):
    li = table(spark, d, "lineitem")
    return ct.combine(ct.value_counts(li.where("l_linenumber < 5"), "l_linenumber"), ct.value_counts(li.where("l_returnflag = 'R'"), "l_linenumber"))


@query("SELECT l_returnflag, string_agg(l_linestatus || ':' || n, ',' ORDER BY l_linestatus) AS cells FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1")
def table_regroup(spark, d):
    cells = ct.regroup(ct.value_counts(table(spark, d, "lineitem"), *FLAGS), "l_returnflag")
    return cells.select("l_returnflag", F.array_join(F.transform("cells", lambda c: F.concat_ws(":", c["l_linestatus"], c["n"].cast("string"))), ",").alias("cells"))


# Information.


def _entropy_sql(log: str) -> str:
    return f"SELECT round(-sum(p * {log}(p)), 9) AS h FROM ({JOINT})"


@query(_entropy_sql("ln"))
def entropy_nats(spark, d):
    return rounded(ct.entropy(table(spark, d, "lineitem"), *FLAGS))


@query(_entropy_sql("log2"))
def entropy_bits(spark, d):
    return rounded(ct.entropy(table(spark, d, "lineitem"), *FLAGS, base=2))


SETS = (("l_returnflag",), ("l_linestatus",), FLAGS, ("l_linenumber", "l_tax"), ("l_linestatus", "l_linenumber", "l_returnflag"))


@query(
    " UNION ALL ".join(
        f"SELECT '{','.join(sorted(s))}' AS vars, round(-sum(p * ln(p)), 9) AS h FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM lineitem GROUP BY {', '.join(s)})" for s in SETS
    )
)
def entropy_grouping_sets(spark, d):
    return rounded(ct.entropies(table(spark, d, "lineitem"), SETS).select(F.array_join("vars", ",").alias("vars"), "h"))


def _mi_sql(x: str, y: str, log: str, of: str = "lineitem") -> str:
    return f"""SELECT sum(n / t * {log}(n * t / (nx * ny))) AS mi FROM (
SELECT n, sum(n) OVER (PARTITION BY {x}) AS nx, sum(n) OVER (PARTITION BY {y}) AS ny, sum(n) OVER () AS t FROM (SELECT {x}, {y}, CAST(count(*) AS DOUBLE) AS n FROM {of} GROUP BY 1, 2))"""


@query(f"SELECT round(mi, 9) AS mi FROM ({_mi_sql(*FLAGS, 'log2')})")
def mutual_information_bits(spark, d):
    return rounded(inf.mutual_information(table(spark, d, "lineitem"), *FLAGS))


@query(f"SELECT round(mi, 9) AS mi FROM ({_mi_sql(*FLAGS, 'ln')})")
def mutual_information_nats(spark, d):
    return rounded(inf.mutual_information(table(spark, d, "lineitem"), *FLAGS, base="e"))


@query(f"SELECT round(mi, 9) AS mi FROM ({_mi_sql('l_tax', 'l_discount', 'log10')})")
def mutual_information_base10(spark, d):
    return rounded(inf.mutual_information(table(spark, d, "lineitem"), "l_tax", "l_discount", base=10))


def _cells(x: str, y: str, z: tuple[str, ...]) -> str:
    part = ", ".join(z)
    over = lambda *by: f"sum(n) OVER ({'PARTITION BY ' + ', '.join(by) if by else ''})"
    return f"""SELECT {part + ', ' if z else ''}{x}, {y}, n, {over(*z)} AS nz, {over(*z, x)} AS nxz, {over(*z, y)} AS nyz, {over()} AS t
FROM (SELECT {part + ', ' if z else ''}{x}, {y}, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY ALL)"""


@query(f"SELECT round(abs(sum(n / t * ln(n * nz / (nxz * nyz)))), 9) AS cmi FROM ({_cells('l_returnflag', 'l_linenumber', ('l_linestatus',))})")
def conditional_mutual_information(spark, d):
    return rounded(inf.conditional_mutual_information(table(spark, d, "lineitem"), "l_returnflag", "l_linenumber", ["l_linestatus"]))


def g_sql(x: str, y: str, z: tuple[str, ...], dof: str = "structural") -> str:
    """One row for a request: the statistic, degrees of freedom, p-value and decision."""
    by = ", ".join(z) if z else "()"
    strata = f"SELECT (count(DISTINCT {x}) - 1) * (count(DISTINCT {y}) - 1) AS v FROM lineitem GROUP BY {by}"
    free = f"SELECT greatest(1, CAST(sum(v) AS BIGINT)) FROM ({strata})"
    if dof == "unadjusted":
        free = f"SELECT greatest(1, (count(DISTINCT {x}) - 1) * (count(DISTINCT {y}) - 1){''.join(f' * count(DISTINCT {c})' for c in z)}) FROM lineitem"
    return f"""SELECT '{x}' AS x, '{y}' AS y, '{','.join(z)}' AS z, round(g, 6) AS g, dof, n, CASE WHEN 5 * dof < n THEN round(p, 6) END AS p, NOT 5 * dof < n AS insufficient, CASE WHEN 5 * dof < n THEN p < 0.95 END AS independent
FROM (SELECT g, dof, n, CASE WHEN g <= 0 THEN 0 ELSE (SELECT sum(exp((dof / 2.0 + k) * ln(g / 2) - g / 2 - lgamma(dof / 2.0 + k + 1))) FROM range(0, 1500) r(k)) END AS p
FROM (SELECT 2 * abs(sum(n * ln(n * nz / (nxz * nyz)))) AS g, ({free}) AS dof, (SELECT count(*) FROM lineitem) AS n FROM ({_cells(x, y, z)})))"""


ONE = ("l_returnflag", "l_linenumber", ("l_linestatus",))
BATCH = [(x, y, z) for x, y in itertools.combinations(sorted(CATEGORIES), 2) for k in (0, 1) for z in itertools.combinations([c for c in sorted(CATEGORIES) if c not in (x, y)], k)]


def _tested(results) -> DataFrame:
    df = results.frame()
    return df.select("x", "y", F.array_join("z", ",").alias("z"), F.round("g", 6).alias("g"), "dof", "n", F.round("p", 6).alias("p"), "insufficient", "independent")


def _test(spark, d, requests, **config) -> DataFrame:
    tester = CITester(table(spark, d, "lineitem", *CATEGORIES), CATEGORIES, CITestConfig(**config))
    tester.batch([Request.of(*r) for r in requests])
    return _tested(tester)


@query(g_sql(*ONE))
def g_test_direct(spark, d):
    return _test(spark, d, [ONE], strategy="direct")


@query(g_sql(*ONE))
def g_test_cuboid(spark, d):
    return _test(spark, d, [ONE], strategy="cuboid")


@query(g_sql(*ONE))
def g_test_entropy(spark, d):
    return _test(spark, d, [ONE], strategy="entropy")


@query(g_sql(*ONE, dof="unadjusted"))
def g_test_unadjusted(spark, d):
    return _test(spark, d, [ONE], strategy="entropy", dof="unadjusted")


@query(" UNION ALL ".join(f"({g_sql(*r)})" for r in BATCH))
def g_test_batch(spark, d):
    return _test(spark, d, BATCH)


@query("SELECT CAST(NULL AS INT) AS idx, CAST(NULL AS DOUBLE) AS g_left, CAST(NULL AS DOUBLE) AS g_right, CAST(NULL AS DOUBLE) AS p_left, CAST(NULL AS DOUBLE) AS p_right WHERE false")
def g_test_strategies_agree(spark, d):
    frames = []
    for s in ("direct", "entropy"):
        tester = CITester(table(spark, d, "lineitem", *CATEGORIES), CATEGORIES, CITestConfig(strategy=s))
        tester.batch([Request.of(*r) for r in BATCH])
        frames.append(tester.frame())
    return disagreements(*frames, tolerance=1e-6)


@query(
    "SELECT 'l_returnflag' AS x, 'l_linenumber' AS y, greatest(1, CAST(sum(v) AS BIGINT)) AS dof FROM (SELECT (count(DISTINCT l_returnflag) - 1) * (count(DISTINCT l_linenumber) - 1) AS v FROM lineitem GROUP BY l_linestatus)"
)
def dof_structural(spark, d):
    tester = CITester(table(spark, d, "lineitem", *CATEGORIES), CATEGORIES)
    return tester.statistics([Request.of(*ONE)]).select(F.lit("l_returnflag").alias("x"), F.lit("l_linenumber").alias("y"), "dof")


TRIPLE = ("l_linenumber", "l_linestatus", "l_returnflag")


@query(
    " UNION ALL ".join(
        f"SELECT '{x}' AS x, '{y}' AS y, greatest(1, CAST(sum(v) AS BIGINT)) AS dof FROM (SELECT (count(DISTINCT {x}) - 1) * (count(DISTINCT {y}) - 1) AS v FROM lineitem GROUP BY {next(c for c in TRIPLE if c not in (x, y))})"
        for x, y in itertools.combinations(TRIPLE, 2)
    )
)
def dof_pairwise(spark, d):
    tester = CITester(table(spark, d, "lineitem", *CATEGORIES), CATEGORIES)
    tester.learn_dofs([frozenset(TRIPLE)])
    return spark.createDataFrame([(*sorted(p), v) for (p, _), v in tester.dofs.items()], "x string, y string, dof long")


POINTS = [(3.84, 1), (0.5, 1), (10.0, 3), (30.0, 24), (250.0, 250), (0.0, 5)]


@query(
    "SELECT g, dof, CASE WHEN g <= 0 THEN 0 ELSE round((SELECT sum(exp((dof / 2.0 + k) * ln(g / 2) - g / 2 - lgamma(dof / 2.0 + k + 1))) FROM range(0, 1500) r(k)), 9) END AS p FROM (VALUES "
    + ", ".join(f"(CAST({g} AS DOUBLE), CAST({k} AS BIGINT))" for g, k in POINTS)
    + ") v(g, dof)"
)
def chi2_distribution(spark, d):
    return spark.createDataFrame(POINTS, "g double, dof long").withColumn("p", F.round(chi2_cdf(F.col("g"), F.col("dof")), 9))


# Ranking and boundaries.


@query(
    "SELECT feature, rank FROM (SELECT feature, CAST(row_number() OVER (ORDER BY round(mi, 12) DESC, ord) AS INT) AS rank FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, {i} AS ord, mi FROM ({_mi_sql(c, 'l_returnflag', 'log2')})" for i, c in enumerate(CATEGORIES[1:]))
    + ")) WHERE rank <= 3"
)
def igt_top(spark, d):
    top = information_gain_ranking(table(spark, d, "lineitem"), CATEGORIES[1:], "l_returnflag", 3)
    return spark.createDataFrame([(f, i + 1) for i, f in enumerate(top)], "feature string, rank int")


def _binary(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select((F.col("l_returnflag") == "R").cast("int").alias("r"), (F.col("l_linestatus") == "F").cast("int").alias("f"), (F.col("l_quantity") > 25).cast("int").alias("q"), (F.col("l_tax") > 0.04).cast("int").alias("t"))


BINARY = "(SELECT CAST(l_returnflag = 'R' AS INT) AS r, CAST(l_linestatus = 'F' AS INT) AS f, CAST(l_quantity > 25 AS INT) AS q, CAST(l_tax > 0.04 AS INT) AS t FROM lineitem)"


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(mi, 9) AS mi FROM ({_mi_sql(c, 'r', 'log2', BINARY)})" for c in "fqt"))
def igt_binary(spark, d):
    return rounded(inf.binary_mutual_information(_binary(spark, d), ["f", "q", "t"], "r"))


#: A network of our own for the queries: a garden.
GARDEN = """
network garden { property author none; }
variable season { type discrete [ 2 ] { dry, wet }; }
variable sprinkler { type discrete [ 2 ] { off, on }; }
variable rain { type discrete [ 3 ] { none, some, much }; }
variable grass { type discrete [ 2 ] { dry, wet }; }
variable slippery { type discrete [ 2 ] { no, yes }; }
probability ( season ) { table 0.6, 0.4; }
probability ( sprinkler | season ) { (dry) 0.3, 0.7; (wet) 0.85, 0.15; }
probability ( rain | season ) { (dry) 0.7, 0.2, 0.1; (wet) 0.2, 0.5, 0.3; }
probability ( grass | sprinkler, rain ) {
  (off, none) 0.95, 0.05; (off, some) 0.3, 0.7; (off, much) 0.05, 0.95;
  (on, none) 0.1, 0.9; (on, some) 0.05, 0.95; (on, much) 0.01, 0.99; }
probability ( slippery | grass ) { (dry) 0.97, 0.03; (wet) 0.4, 0.6; }
"""


def garden():
    return parse_bif(GARDEN).finalize()


def _factors_sql() -> str:
    net, parts = garden(), []
    for n in net.names:
        node = net.nodes[n]
        rows = ", ".join(f"({', '.join(repr(v) for v in (*k, v))}, CAST({p} AS DOUBLE))" for k, ps in node.table.items() for v, p in zip(node.values, ps, strict=True))
        parts.append(f"f_{n} AS (SELECT * FROM (VALUES {rows}) v({', '.join((*node.parents, n, 'p'))}))")
    return "WITH " + ",\n".join(parts) + """,
j AS (SELECT season, sprinkler, rain, grass, slippery, a.p * b.p * c.p * e.p * g.p AS p
FROM f_season a JOIN f_sprinkler b USING (season) JOIN f_rain c USING (season) JOIN f_grass e USING (sprinkler, rain) JOIN f_slippery g USING (grass))
"""


@query(_factors_sql() + "SELECT grass, rain, season, slippery, sprinkler, round(p, 12) AS p FROM j")
def bn_joint(spark, d):
    return rounded(garden().joint(spark), 12)


@query(_factors_sql() + "SELECT rain, sprinkler, round(sum(p), 12) AS p FROM j GROUP BY ALL")
def bn_partial_joint(spark, d):
    return rounded(garden().partial_joint(spark, ["rain", "sprinkler"]), 12)


@query("SELECT * FROM (VALUES (0, 'grass', 'dry,wet'), (1, 'rain', 'none,some,much'), (2, 'season', 'dry,wet'), (3, 'slippery', 'no,yes'), (4, 'sprinkler', 'off,on')) v(id, name, \"values\")")
def bn_nodes(spark, d):
    return garden().node_frame(spark).select("id", "name", F.array_join("values", ",").alias("values"))


EDGES = "(VALUES (2, 4, 0), (2, 1, 0), (4, 0, 0), (1, 0, 1), (0, 3, 0)) v(parent, child, parent_pos)"


@query(f"SELECT * FROM {EDGES}")
def bn_edges(spark, d):
    return garden().edge_frame(spark)


@query(
    "WITH c AS (SELECT * FROM (VALUES (2, '', 0, 0.6), (2, '', 1, 0.4), (1, 'dry', 0, 0.7), (1, 'dry', 1, 0.2), (1, 'dry', 2, 0.1), (1, 'wet', 0, 0.2), (1, 'wet', 1, 0.5), (1, 'wet', 2, 0.3)) v(node, parent_values, value_idx, p)) "
    "SELECT node, parent_values, value_idx, CAST(p AS DOUBLE) AS p, round(CAST(sum(p) OVER (PARTITION BY node, parent_values ORDER BY value_idx) AS DOUBLE), 12) AS cum FROM c"
)
def bn_cumulative(spark, d):
    cpt = garden().cpt_frame(spark).where("node in (1, 2)")
    return cpt.select("node", F.array_join("parent_values", ",").alias("parent_values"), "value_idx", "p", F.round("cum", 12).alias("cum"))


@query(
    f"""WITH RECURSIVE e AS (SELECT parent AS a, child AS b FROM {EDGES} UNION SELECT child, parent FROM {EDGES}),
w AS (SELECT 2 AS node, [2] AS path UNION ALL SELECT e.b, list_append(path, e.b) FROM w JOIN e ON e.a = w.node WHERE w.node <> 0 AND NOT list_contains(path, e.b))
SELECT array_to_string(path, '-') AS path FROM w WHERE node = 0"""
)
def bn_paths(spark, d):
    return path_frame(garden().edge_frame(spark), 2, 0).select(F.array_join(F.transform("path", lambda x: x.cast("string")), "-").alias("path"))


@query(f"WITH RECURSIVE a AS (SELECT 0 AS id UNION SELECT parent FROM a JOIN {EDGES} ON child = a.id) SELECT id FROM a")
def bn_ancestors(spark, d):
    net = garden()
    return spark.createDataFrame([(net.number[n],) for n in net.ancestors(["grass"])], "id int")


@query(
    f"""WITH RECURSIVE d AS (SELECT parent, child FROM {EDGES}),
e AS (SELECT parent AS a, child AS b FROM d UNION SELECT child, parent FROM d),
q AS (SELECT x.i AS x, y.i AS y, z.i AS z FROM range(0, 5) x(i), range(0, 5) y(i), range(0, 5) z(i) WHERE x.i < y.i AND z.i NOT IN (x.i, y.i)),
w AS (SELECT x, y, z, x AS node, [x] AS path, true AS active FROM q
  UNION ALL SELECT w.x, w.y, w.z, e.b, list_append(path, e.b), active AND (len(path) = 1 OR
    CASE WHEN EXISTS (SELECT 1 FROM d WHERE parent = path[-2] AND child = w.node) AND EXISTS (SELECT 1 FROM d WHERE parent = e.b AND child = w.node)
    THEN w.z = w.node OR EXISTS (SELECT 1 FROM d WHERE parent = w.node AND child = w.z) ELSE w.z <> w.node END)
  FROM w JOIN e ON e.a = w.node WHERE w.node <> w.y AND NOT list_contains(path, e.b))
SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(z AS INT) AS z, NOT bool_or(active AND node = y) AS separated FROM w GROUP BY x, y, z"""
)
def bn_dsep(spark, d):
    net = garden()
    rows = [(i, j, k, net.d_separated(net.names[i], [net.names[k]], net.names[j])) for i in range(5) for j in range(i + 1, 5) for k in range(5) if k not in (i, j)]
    return spark.createDataFrame(rows, "x int, y int, z int, separated boolean")


@query(
    _factors_sql()
    + """, k AS (SELECT *, row_number() OVER (ORDER BY p DESC, grass, rain, season, slippery, sprinkler) AS r, greatest(1, CAST(round_even(200 * p, 0) AS INT)) AS w FROM j WHERE p > 0),
b AS (SELECT *, coalesce(sum(w) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
SELECT grass, rain, season, slippery, sprinkler, CAST(greatest(least(w, 200 - before), 0) AS BIGINT) AS n FROM b WHERE before < 200"""
)
def exact_instances(spark, d):
    return ct.exact_instances(garden().joint(spark), 200)


@query(None)
def bn_sample_marginals(spark, d):
    return ct.pmf(garden().sample(spark, 20_000, seed=5), "rain", "grass")


@query("SELECT 'exact' AS method, 400 AS n_rows, 3 AS n_features, 2 AS n_objectives")
def bn_sample_source(spark, d):
    data = NetworkSampleSource(spark, garden(), 400, ["grass", "slippery"], "exact").create()
    return spark.createDataFrame([("exact", data.row_count(), len(data.features), len(data.objectives))], "method string, n_rows int, n_features int, n_objectives int")


def _boundaries(spark, found) -> DataFrame:
    return spark.createDataFrame([(t, ",".join(m)) for t, m in found.items()], "target string, boundary string")


TRUE = "SELECT * FROM (VALUES ('season', 'rain,sprinkler'), ('sprinkler', 'grass,rain,season'), ('rain', 'grass,season,sprinkler'), ('grass', 'rain,slippery,sprinkler'), ('slippery', 'grass')) v(target, boundary)"


def _dsep(spark) -> CITester:
    net = garden()
    return CITester(spark.range(1), net.names, CITestConfig(strategy="dsep", network=net))


@query(TRUE)
def ipcmb_dsep(spark, d):
    return _boundaries(spark, ipcmb_all(_dsep(spark)))


@query(TRUE)
def iamb_dsep(spark, d):
    from margrave.plans.boundary import distance_heuristic

    return _boundaries(spark, {t: iamb(_dsep(spark), t, distance_heuristic(garden())) for t in garden().names})


@query(TRUE)
def ipcmb_exact_samples(spark, d):
    net = garden()
    tester = CITester(net.exact_samples(spark, 40_000), net.names, CITestConfig(significance=0.99, strategy="cuboid"))
    return _boundaries(spark, ipcmb_all(tester))


@query(TRUE)
def pcmb_dsep(spark, d):
    from margrave.plans.boundary import separation_heuristic

    return _boundaries(spark, {t: pcmb(_dsep(spark), t, separation_heuristic(garden())) for t in garden().names})


@query(None)
def ipcmb_lineitem(spark, d):
    tester = CITester(table(spark, d, "lineitem", *CATEGORIES), CATEGORIES, CITestConfig(strategy="cuboid"))
    return _boundaries(spark, ipcmb_all(tester))


@query(None)
def ipcmb_pc_only(spark, d):
    tester = CITester(table(spark, d, "lineitem", *CATEGORIES), CATEGORIES, CITestConfig(strategy="entropy"))
    return _boundaries(spark, {"l_returnflag": ipcmb(tester, "l_returnflag", pc_only=True)})


@query(None)
def iamb_lineitem(spark, d):
    tester = CITester(table(spark, d, "lineitem", *CATEGORIES), CATEGORIES)
    return _boundaries(spark, {"l_returnflag": iamb(tester, "l_returnflag")})


# Datasets.

WORDS = r"list_filter(string_split_regex(trim(text), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"


@query(f"SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest({WORDS}) AS word FROM documents) GROUP BY ALL")
def doc_term_counts(spark, d):
    return word_counts(table(spark, d, "documents"))


@query(f"SELECT DISTINCT doc_id, word, 1 AS present FROM (SELECT doc_id, unnest({WORDS}) AS word FROM documents)")
def doc_presence(spark, d):
    return word_counts(table(spark, d, "documents")).select("doc_id", "word", F.lit(1).alias("present"))


@query(f"SELECT word, CAST(row_number() OVER (ORDER BY word COLLATE \"C\") - 1 AS BIGINT) AS idx FROM (SELECT DISTINCT unnest({WORDS}) AS word FROM documents)")
def doc_vocabulary(spark, d):
    return vocabulary(word_counts(table(spark, d, "documents")))


@query("SELECT l.doc_id, CAST(quality AS VARCHAR) AS topic FROM labels l JOIN documents USING (doc_id)")
def doc_topic_join(spark, d):
    topics = table(spark, d, "labels").select(F.col("quality").cast("string").alias("topic"), "doc_id")
    return DocTermSource(table(spark, d, "documents", "doc_id", "text"), topics).long()[2].select("doc_id", "topic")


@query("SELECT doc_id FROM documents WHERE lang = 'de'")
def industry_filter(spark, d):
    return ids_in_industry(table(spark, d, "documents").select(F.col("lang").alias("industry"), "doc_id"), "de")


@query("SELECT 'r' AS col, avg(r) AS share FROM " + BINARY + " UNION ALL SELECT 'f', avg(f) FROM " + BINARY + " UNION ALL SELECT 'q', avg(q) FROM " + BINARY + " UNION ALL SELECT 't', avg(t) FROM " + BINARY)
def column_popularity(spark, d):
    row = share_of_ones(_binary(spark, d), *"rfqt")
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("share")) for c in "rfqt"])).alias("s")).select("s.*")


@query(
    "SELECT col FROM (SELECT 'r' AS col, avg(r) AS m FROM " + BINARY + " UNION ALL SELECT 'f', avg(f) FROM " + BINARY + " UNION ALL SELECT 'q', avg(q) FROM " + BINARY + " UNION ALL SELECT 't', avg(t) FROM " + BINARY + ") WHERE m < 0.3 OR m > 0.52"
)
def threshold_prune(spark, d):
    gone = columns_to_remove(Dataset.of(_binary(spark, d)), "X", (0.3, 0.52))
    return spark.createDataFrame([(c,) for c in gone.values()], "col string")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey * 2654435761 % 4294967296, o_orderkey) <= (SELECT count(*) * 3 // 4 FROM orders) AS is_train FROM orders")
def split_exact(spark, d):
    o = table(spark, d, "orders", "o_orderkey")
    return split_rows(o, o.count() * 3 // 4, "o_orderkey", order=[F.expr("o_orderkey * 2654435761L % 4294967296L"), F.col("o_orderkey")])


@query("SELECT 'train' AS part, CAST(floor(count(*) * 0.25) AS BIGINT) AS n FROM customer UNION ALL SELECT 'test', count(*) - CAST(floor(count(*) * 0.25) AS BIGINT) FROM customer")
def split_sizes(spark, d):
    data = Dataset.of(table(spark, d, "customer").withColumnRenamed("c_custkey", "row_id"), ["c_mktsegment"])
    split = SplitDataset.build(data, SplitOptions(0.25, 42))
    return spark.createDataFrame([(p, split.part(p).row_count()) for p in ("train", "test")], "part string, n long")


def _nations(spark, d) -> Dataset:
    return Dataset.of(table(spark, d, "nation").withColumnRenamed("n_nationkey", "row_id"), ["n_name", "n_regionkey"])


@query("SELECT n_nationkey AS row_id, n_name, n_regionkey FROM nation WHERE n_nationkey IN (1, 5, 7)")
def select_rows(spark, d):
    return _nations(spark, d).select_rows([7, 1, 5]).df


@query("SELECT n_nationkey AS row_id, n_name, n_regionkey FROM nation WHERE n_nationkey NOT IN (0, 3)")
def delete_rows(spark, d):
    return _nations(spark, d).delete_rows([0, 3]).df


@query("SELECT n_nationkey AS row_id, n_regionkey FROM nation")
def select_columns(spark, d):
    return _nations(spark, d).select_columns([1]).df


@query("SELECT n_nationkey AS row_id, n_name FROM nation")
def delete_columns(spark, d):
    return _nations(spark, d).delete_columns("X", 1).df


@query("SELECT n_name FROM nation")
def column_by_label(spark, d):
    return _nations(spark, d).column_by_label("X", "n_name")


@query("SELECT true AS same, 'rows' AS differs")
def dataset_equality(spark, d):
    a = _nations(spark, d)
    return spark.createDataFrame([(a.equals(_nations(spark, d)), ",".join(a.diff(a.delete_rows([2]))))], "same boolean, differs string")


@query("SELECT CAST(i AS BIGINT) AS row_id, 'row' || i AS row_label, " + ", ".join(f"CAST(i = {k} AS INT) AS {n}{k}" for n in ("feature", "objective") for k in range(8)) + " FROM range(0, 8) r(i)")
def identity_source(spark, d):
    return IdentitySource(spark).create().df


@query("SELECT 250 AS a, 0 AS b, 1000 AS c, 333 AS y, 1000 AS n")
def synthetic_binary_source(spark, d):
    data = SyntheticBinarySource(spark, 1000, {"a": 0.25, "b": 0.0, "c": 1.0}, {"y": 0.3333}, 7).create()
    return data.df.agg(*[F.sum(c).cast("int").alias(c) for c in ("a", "b", "c", "y")], F.count("*").cast("int").alias("n"))


# Windows, ranks, summaries.


@query("SELECT event_id, user_id, sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS elapsed FROM (SELECT event_id, user_id, round(value * 100) AS value FROM events)")
def running_duration(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", F.round(F.col("value") * 100).alias("value"))
    return exp.running_duration(events, "event_id", "value", "user_id").select("event_id", "user_id", "elapsed")


@query("SELECT s_suppkey, CAST(row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS BIGINT) AS rank FROM supplier")
def stable_rank(spark, d):
    return numbered(table(spark, d, "supplier"), F.desc("s_acctbal"), F.asc("s_suppkey"), name="rank").select("s_suppkey", "rank")


@query("SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality <> 1 AND toxic <> 1) AS tn, count(*) FILTER (quality <> 1 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic <> 1) AS fn FROM labels")
def confusion_counts(spark, d):
    return exp.confusion(table(spark, d, "labels"), "quality", "toxic")


FOUND = [("a", ["b", "c"]), ("b", []), ("c", ["a", "d", "e"])]
WANT = [("a", ["b", "d"]), ("b", ["a"]), ("c", ["a", "d", "e"])]


@query(
    "SELECT * FROM (VALUES ('a', 2, CAST(0.5 AS DOUBLE), CAST(0.5 AS DOUBLE), round(sqrt(0.5), 9)), ('b', 1, 0.0, 0.0, round(sqrt(2), 9)), ('c', 0, 1.0, 1.0, 0.0)) v(target, errors, precision, recall, distance)"
)
def boundary_quality(spark, d):
    schema = "target string, boundary array<string>"
    return rounded(exp.boundary_quality(spark.createDataFrame(FOUND, schema), spark.createDataFrame(WANT, schema)))


def _timed(spark, d) -> DataFrame:
    """A stand-in for test results of known durations: events."""
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("idx"), F.col("value").alias("duration_s"), F.when(F.col("event_id") % 3 == 0, F.array()).otherwise(F.array(F.lit("a"))).cast("array<string>").alias("z"),
        (F.col("event_id") % 2 == 0).alias("independent"), (F.col("event_id") % 5 != 0).alias("dsep"),
    )


@query(
    """SELECT count(*) AS tests, round(sum(value), 4) AS total_s, round(avg(value), 6) AS mean_s, max(value) AS max_s, round(median(value), 6) AS median_s, round(count(*) / sum(value), 6) AS tests_per_s,
round(avg(CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END), 9) AS mean_size, round(avg(CAST((event_id % 2 = 0) = (event_id % 5 <> 0) AS INT)), 9) AS accuracy FROM events"""
)
def ci_summary(spark, d):
    r = exp.test_summary(_timed(spark, d))
    return r.select("tests", F.round("total_s", 4).alias("total_s"), F.round("mean_s", 6).alias("mean_s"), "max_s", F.round("median_s", 6).alias("median_s"), F.round("tests_per_s", 6).alias("tests_per_s"), F.round("mean_size", 9).alias("mean_size"), F.round("accuracy", 9).alias("accuracy"))


@query("SELECT CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS size, count(*) AS n FROM events GROUP BY 1")
def conditioning_sizes(spark, d):
    return exp.conditioning_sizes(_timed(spark, d))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_event_counts(spark, d):
    return windowed_counts(table(spark, d, "events"), "ts", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(None)
def windowed_event_dependence(spark, d):
    events = table(spark, d, "events").withColumn("large", F.col("value") > 50)
    return windowed_mi(windowed_counts(events, "ts", "event_type", "large"), "event_type", "large")


@query(None)
def naive_bayes_confusion(spark, d):
    data = Dataset.of(_binary(spark, d), ["f", "q", "t"], ["r"])
    return exp.classify(SplitDataset.build(data, SplitOptions(0.5, 3)), ["f", "q", "t"], "r")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of the categorical columns of lineitem tested given each other column, in one job."""
    return g_test_batch(spark, sf_dir)




import margrave.queries_stored  # noqa: E402, F401  registers more

"""Comparisons of strategies and of algorithms: what they cost, and how right they are."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from margrave.experiment import boundary_quality, test_summary
from margrave.operators.bayesnet import BayesianNetwork
from margrave.operators.citest import CITestConfig, CITester
from margrave.operators.cuboids import CuboidCache
from margrave.plans.boundary import cmi_heuristic, distance_heuristic, iamb, ipcmb_all
from margrave.storage import stored_bytes, written


def run_id(source: str, network: str, algorithm: str, target: str | int, samples: int | None = None) -> str:
    """`<bn|ds>_<network>[_<samples>]_<algorithm>_T<target>`."""
    return "_".join([source, network, *([f"{samples:.0e}".replace("e+0", "e")] if samples else []), algorithm, f"T{target}"])


def sample_count(text: str) -> int:
    """A number of samples written as `4e4`."""
    base, _, power = text.partition("e")
    if not (base.isdigit() and power.isdigit()):
        raise ValueError(f"{text!r} isn't of the form 4e4")
    return int(base) * 10 ** int(power)


def true_boundaries(network: BayesianNetwork, spark: SparkSession, algorithm: str = "ipcmb") -> dict[str, list[str]]:
    """Boundaries of all nodes as the algorithm finds them when the network itself answers its tests."""
    tester = lambda: CITester(spark.range(1), network.names, CITestConfig(strategy="dsep", network=network))
    if algorithm == "iamb":
        return {t: iamb(tester(), t, distance_heuristic(network)) for t in network.names}
    return ipcmb_all(tester())


def _frame(spark: SparkSession, found: Mapping[str, Sequence[str]]) -> DataFrame:
    return spark.createDataFrame([(t, list(m)) for t, m in found.items()], "target string, boundary array<string>")


def accuracy(spark: SparkSession, network: BayesianNetwork, data: DataFrame, config: CITestConfig, algorithms: Sequence[str] = ("ipcmb", "iamb")) -> DataFrame:
    """A row per algorithm: mean precision, recall and distance over all targets, sum of errors, and the share of tests that agree with d-separation."""
    out = None
    for name in algorithms:
        tester = CITester(data, network.names, config)
        tester.config.network = network
        found = ipcmb_all(tester) if name == "ipcmb" else {t: iamb(tester, t, cmi_heuristic(tester)) for t in network.names}
        q = boundary_quality(_frame(spark, found), _frame(spark, true_boundaries(network, spark, name)))
        row = q.agg(F.sum("errors").alias("errors"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("distance").alias("distance"))
        row = row.crossJoin(test_summary(tester.frame()).select("tests", "total_s", "accuracy")).withColumn("algorithm", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def strategies(data: DataFrame, columns: Sequence[str], significance: float = 0.95, names: Sequence[str] = ("direct", "cuboid", "entropy")) -> list[dict]:
    """Per strategy: tests, seconds, tests a second, and entropies read and computed, for all boundaries of the columns."""
    out = []
    for name in names:
        began = time.time()
        tester = CITester(data, columns, CITestConfig(strategy=name, significance=significance))
        ipcmb_all(tester)
        s = time.time() - began
        out.append({"strategy": name, "tests": len(tester.results), "seconds": s, "per_second": len(tester.results) / s, "reads": tester.reads, "misses": tester.misses})
    return out


def grid(data: DataFrame, columns: Sequence[str], network: BayesianNetwork | None = None, significance: float = 0.95, admits: Sequence[float] = (0.0, 0.005, 0.01)) -> list[dict]:
    """The run families of the comparison of test caches, as parameters of CITestConfig with a tag each.

    d-separation (with a network), samples without a cache, stored cuboids of all columns made ahead (static) or of what is
    asked (dynamic) for each share of the samples that their cells may have, and joint entropies."""
    out = [{"tag": "dsep", "strategy": "dsep", "network": network}] if network else []
    out.append({"tag": "unoptimized", "strategy": "direct"})
    for kind, admit in ((k, a) for k in ("static", "dynamic") for a in admits):
        out.append({"tag": f"{kind}_{round(1000 * admit)}", "strategy": "cuboid", "admit": admit, "static": kind == "static"})
    out.append({"tag": "entropy", "strategy": "entropy"})
    return [{"significance": significance, **r} for r in out]


def run_grid(data: DataFrame, columns: Sequence[str], runs: Sequence[Mapping]) -> list[dict]:
    """Boundaries of all columns by each run of the grid: tag, boundaries, tests, seconds, and passes over the samples."""
    out = []
    for r in runs:
        began = time.time()
        own = {k: v for k, v in r.items() if k not in ("tag", "static")}
        if r.get("static"):
            own["cuboids"] = CuboidCache(data, columns, admit=1.0)
            own["cuboids"].build([columns])
        tester = CITester(data, columns, CITestConfig(**own))
        found = ipcmb_all(tester)
        out.append({"tag": r["tag"], "boundaries": found, "tests": len(tester.results), "seconds": time.time() - began, "scans": None if tester.n is None else tester.counter.scans})
    return out


def cuboid_stats(data: DataFrame, columns: Sequence[str]) -> dict:
    """Rows, cells, their ratio (what the admission rule compares), bytes of the stored table, and seconds to count and store it."""
    began = time.time()
    rows, table = data.count(), written(data.groupBy(*columns).agg(F.count("*").alias("n")), "cuboid")
    cells = table.count()
    return {"columns": sorted(columns), "rows": rows, "cells": cells, "ratio": cells / max(rows, 1), "bytes": stored_bytes(table), "seconds": time.time() - began}


def stored_stats(cache: CuboidCache) -> list[dict]:
    """Of each set that a cache has stored: columns, cells, ratio to the rows, and bytes where it is a written table."""
    return [
        {"columns": sorted(s), "cells": n, "ratio": n / max(cache.rows, 1), "bytes": stored_bytes(t) if cache.path else None} for s, (t, n) in sorted(cache.stored.items(), key=lambda x: sorted(x[0]))
    ]

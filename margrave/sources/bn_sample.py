"""Samples of a Bayesian network as a dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from margrave.dataset import Dataset
from margrave.operators.bayesnet import BayesianNetwork


class NetworkSampleSource:
    """Cells are value numbers. method: 'random' (ancestral sampling) or 'exact' (rows in proportion to the joint distribution)."""

    def __init__(self, spark: SparkSession, network: BayesianNetwork, rows: int, objectives: Sequence[str] = (), method: str = "random", seed: int = 0):
        if method not in ("random", "exact"):
            raise ValueError(f"unknown sampling method {method!r}")
        self.spark, self.network, self.rows, self.objectives, self.method, self.seed = spark, network, rows, sorted(objectives), method, seed

    def create(self, label: str = "sample", seed: int | None = None) -> Dataset:
        net = self.network if self.network.final else self.network.finalize()
        df = net.exact_samples(self.spark, self.rows) if self.method == "exact" else net.sample(self.spark, self.rows, self.seed if seed is None else seed)
        df = df.withColumn("row_label", F.concat(F.lit("row"), F.col("row_id")))
        return Dataset.of(df, [n for n in net.names if n not in self.objectives], self.objectives, label)

"""What a dataset source is, and the simplest one."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from margrave.dataset import Dataset


class DatasetSource(Protocol):
    def create(self, label: str) -> Dataset: ...


class IdentitySource:
    """Two identity matrices, as features and objectives."""

    def __init__(self, spark: SparkSession, size: int = 8):
        self.spark, self.size = spark, size

    def create(self, label: str = "identity") -> Dataset:
        n = self.size
        cell = lambda i: (F.col("row_id") == i).cast("int")
        df = self.spark.range(n).withColumnRenamed("id", "row_id")
        df = df.select("row_id", F.concat(F.lit("row"), F.col("row_id")).alias("row_label"), *[cell(i).alias(f"feature{i}") for i in range(n)], *[cell(i).alias(f"objective{i}") for i in range(n)])
        return Dataset.of(df, [f"feature{i}" for i in range(n)], [f"objective{i}" for i in range(n)], label)

"""Binary columns with an exact share of ones, at random rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from margrave.dataset import Dataset, numbered


class SyntheticBinarySource:
    """features and objectives: share of ones by column name. Column c has ones in exactly int(rows * share) rows: those whose seeded hashes come first."""

    def __init__(self, spark: SparkSession, rows: int, features: Mapping[str, float], objectives: Mapping[str, float] | None = None, seed: int = 0):
        self.spark, self.rows, self.features, self.objectives, self.seed = spark, rows, dict(features), dict(objectives or {}), seed

    def create(self, label: str = "binary", seed: int | None = None) -> Dataset:
        seed = self.seed if seed is None else seed
        shares = [(c, role, p) for role, cols in (("X", self.features), ("Y", self.objectives)) for c, p in sorted(cols.items())]
        if len({c for c, *_ in shares}) < len(shares):
            raise ValueError("a column is a feature or an objective, not both")
        base = self.spark.range(self.rows).withColumnRenamed("id", "row_id")
        # one shuffle places all columns: (column, hash) order, numbered inside each column
        names = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(int(self.rows * p)).alias("ones"), F.lit(i).alias("i")) for i, (c, _, p) in enumerate(shares)])
        long = base.select("row_id", F.explode(names).alias("s")).select("row_id", "s.*").withColumn("h", F.xxhash64("row_id", "c", F.lit(seed)))
        placed = numbered(long, "i", "h", "row_id", name="place").withColumn("one", F.col("place") - F.col("i") * self.rows <= F.col("ones"))
        wide = placed.groupBy("row_id").agg(*[F.max(F.when(F.col("i") == i, F.col("one").cast("smallint"))).alias(c) for i, (c, _, _) in enumerate(shares)])
        wide = wide.withColumn("row_label", F.concat(F.lit("row"), F.col("row_id")))
        return Dataset.of(wide, [c for c, r, _ in shares if r == "X"], [c for c, r, _ in shares if r == "Y"], label)


def share_of_ones(df: DataFrame, *cols: str) -> DataFrame:
    return df.agg(*[F.avg(c).alias(c) for c in cols])

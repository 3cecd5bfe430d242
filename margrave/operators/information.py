"""Mutual information and conditional mutual information of columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from margrave.functions.info import cmi_term, mi_term
from margrave.operators.counts import value_counts


def mutual_information(df: DataFrame, x: str, y: str, base: float | str = 2) -> DataFrame:
    """One row: mi. Only cells that occur are visited; a null is a value."""
    cells = value_counts(df, x, y)
    total = F.broadcast(cells.agg(F.sum("n").alias("total")))
    cells = cells.withColumn("nx", F.sum("n").over(Window.partitionBy(x))).withColumn("ny", F.sum("n").over(Window.partitionBy(y))).crossJoin(total)
    return cells.agg(F.coalesce(F.sum(mi_term(F.col("n"), F.col("nx"), F.col("ny"), F.col("total"), base)), F.lit(0.0)).alias("mi"))


def conditional_mutual_information(df: DataFrame, x: str, y: str, z: Sequence[str], base: float | str = "e") -> DataFrame:
    """One row: cmi, never negative. Without z the mutual information."""
    if not z:
        return mutual_information(df, x, y, base).select(F.abs("mi").alias("cmi"))
    cells = value_counts(df, *z, x, y)
    total = F.broadcast(cells.agg(F.sum("n").alias("total")))
    over = lambda *by: F.sum("n").over(Window.partitionBy(*by))
    cells = cells.withColumn("nz", over(*z)).withColumn("nxz", over(*z, x)).withColumn("nyz", over(*z, y)).crossJoin(total)
    term = cmi_term(F.col("n"), F.col("nxz"), F.col("nyz"), F.col("nz"), F.col("total"), base)
    return cells.agg(F.abs(F.coalesce(F.sum(term), F.lit(0.0))).alias("cmi"))


def information_gains(df: DataFrame, objective: str, features: Sequence[str], base: float | str = 2) -> DataFrame:
    """(feature, mi) of every feature with the objective, by one aggregation over all features' cells."""
    long = df.select(F.col(objective).alias("y"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("x")) for f in features])).alias("c")).select("y", "c.*")
    cells = long.groupBy("feature", "x", "y").agg(F.count("*").alias("n"))
    over = lambda *by: F.sum("n").over(Window.partitionBy("feature", *by))
    cells = cells.withColumn("nx", over("x")).withColumn("ny", over("y")).withColumn("total", over())
    return cells.groupBy("feature").agg(F.sum(mi_term(F.col("n"), F.col("nx"), F.col("ny"), F.col("total"), base)).alias("mi"))


def binary_mutual_information(df: DataFrame, features: Sequence[str], objective: str) -> DataFrame:
    """(feature, mi) in bits of 0/1 columns: all counts of all features are sums of one scan, without a shuffle of rows."""
    sums = [F.sum(F.col(f).cast("long")).alias(f"x{i}") for i, f in enumerate(features)]
    both = [F.sum((F.col(f) * F.col(objective)).cast("long")).alias(f"b{i}") for i, f in enumerate(features)]
    one = df.agg(F.count("*").alias("n"), F.sum(F.col(objective).cast("long")).alias("y"), *sums, *both)
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"x{i}").alias("x"), F.col(f"b{i}").alias("b")) for i, f in enumerate(features)]))
    r = one.select("n", "y", rows.alias("r")).select("n", "y", "r.*")

    def term(n, nx, ny):
        return F.when(n > 0, mi_term(n, nx, ny, F.col("n"))).otherwise(0.0)

    n, x, y, b = (F.col(c) for c in ("n", "x", "y", "b"))
    return r.select("feature", (term(b, x, y) + term(x - b, x, n - y) + term(y - b, n - x, y) + term(n - x - y + b, n - x, n - y)).alias("mi"))

"""Matrices in Matrix Market files, with labels in text files beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from margrave.dataset import Dataset


def read_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[int, int]]:
    """(row_id, col_id, value) from 0 of a coordinate file, and its shape."""
    lines = spark.read.text(path).where("value not like '\\%%' and trim(value) <> ''").select(F.split(F.trim("value"), r"\s+").alias("v"))
    head = spark.read.text(path).where("value not like '\\%%' and trim(value) <> ''").first()[0].split()
    rows = lines.where(F.size("v") == 3).withColumn("at", F.monotonically_increasing_id()).where("at > 0")
    return rows.select((F.col("v")[0].cast("long") - 1).alias("row_id"), (F.col("v")[1].cast("int") - 1).alias("col_id"), F.col("v")[2].cast("double").cast("int").alias("value")), (int(head[0]), int(head[1]))


def load_dataset(spark: SparkSession, folder: str, label: str) -> Dataset:
    """A finalized dataset from X.mtx, Y.mtx, row_labels.txt, column_labels_X.txt and column_labels_Y.txt."""
    read = lambda name: [r[0] for r in spark.read.text(f"{folder}/{label}/{name}").collect()]  # noqa: E731  labels of columns
    names = {m: read(f"column_labels_{m}.txt") for m in "XY"}
    labels = spark.read.text(f"{folder}/{label}/row_labels.txt").withColumn("row_id", F.monotonically_increasing_id()).select("row_id", F.col("value").alias("row_label"))
    out = labels
    for m in "XY":
        long, _ = read_matrix(spark, f"{folder}/{label}/{m}.mtx")
        wide = long.groupBy("row_id").agg(*[F.coalesce(F.sum(F.when(F.col("col_id") == i, F.col("value"))), F.lit(0)).cast("int").alias(c) for i, c in enumerate(names[m])])
        out = out.join(wide, "row_id", "left").fillna(0)
    return Dataset.of(out, names["X"], names["Y"], label).finalized()

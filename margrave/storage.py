"""Intermediate tables in the folder all executors share, and total orders over them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where that is unset, a temporary folder in local mode, and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="margrave-")
        atexit.register(shutil.rmtree, root.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read from there: the same rows in every later job, whatever executors are lost."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_bytes(table: DataFrame) -> int:
    """Bytes of the files of a written table."""
    spark, total = table.sparkSession, 0
    for name in table.inputFiles():
        p = spark._jvm.org.apache.hadoop.fs.Path(name)
        total += p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen()
    return total


def ranged(df: DataFrame, *order) -> DataFrame:
    """df with __part, which grows with the order, and __row, the place from 0 inside it: range partitions, sorted and written."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    return written(parts.withColumn("__part", F.shiftright("__at", 33)).withColumn("__row", F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at"), "ordered")


def before(parts: DataFrame, weight: Column, name: str = "__before") -> DataFrame:
    """ranged rows with the sum of weight over all rows before each. Only a total per partition meets in one task."""
    own = parts.withColumn("__w", weight)
    sums = own.groupBy("__part").agg(F.sum("__w").alias("__sum"))
    first = sums.select("__part", F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__first"))
    inside = F.coalesce(F.sum("__w").over(Window.partitionBy("__part").orderBy("__row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.withColumn("__inside", inside).join(F.broadcast(first), "__part").withColumn(name, F.col("__first") + F.col("__inside")).drop("__w", "__first", "__inside")


def numbered(df: DataFrame, *order, name: str = "rn") -> DataFrame:
    """df with each row's place, from 1, in a total order: rows are counted by range partition, so no task sees all rows."""
    parts = ranged(df, *order)
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    first = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__first"))
    return parts.join(F.broadcast(first), "__part").withColumn(name, (F.col("__first") + F.col("__row") + 1).cast("long")).drop("__part", "__row", "__first")

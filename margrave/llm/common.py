"""Helpers shared by the corpus operators: durable scratch tables, input shaping, sizing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from margrave.storage import shared_folder

#: Rows of an Arrow batch, texts being long.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, fmt: str = "parquet") -> DataFrame:
    """Cut lineage: write df to the shared folder, read it back. Survives the loss of any executor."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.format(fmt).save(path)
    return spark.read.schema(df.schema).format(fmt).load(path)


def free_name(name: str, *taken: list[str]) -> str:
    """name, with as many underscores after it as make it unlike all names taken, whatever their case."""
    used = {c.lower() for names in taken for c in names}
    while name.lower() in used:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def total_bytes(df: DataFrame, text: str) -> int:
    return df.agg(F.coalesce(F.sum(F.octet_length(F.col(text)).cast("long")), F.lit(0))).first()[0]


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, where it isn't installed there, and Arrow batches of texts a size that fits them."""
    if spark.conf.get(BATCH) == "10000":  # the default, meant for rows of a few numbers
        spark.conf.set(BATCH, str(BATCH_ROWS))
    sc = spark.sparkContext
    if getattr(sc, "_margrave_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    if package.parent.name.endswith(".zip"):
        return
    d = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    shutil.copytree(package, f"{d}/in/margrave", ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(f"{d}/margrave", "zip", f"{d}/in"))
    sc._margrave_shipped = True

"""Contingency counts over windows of a stream, and what they say about dependence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from margrave.functions.info import cmi_term


def windowed_counts(events: DataFrame, time: str, *cols: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, cols, n) for a stream or a table: state is a row per open window and combination of values; later events are dropped."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late) if events.isStreaming else rows
    return rows.groupBy(F.window(time, window).alias("w"), *cols).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *cols, "n")


def windowed_mi(counts: DataFrame, x: str, y: str) -> DataFrame:
    """(start, mi) in nats of the counts of each window, for a table of closed windows."""
    over = lambda *by: F.sum("n").over(Window.partitionBy("start", *by))
    cells = counts.groupBy("start", x, y).agg(F.sum("n").alias("n")).select("start", "n", over(x).alias("nx"), over(y).alias("ny"), over().alias("t"))
    return cells.groupBy("start").agg(F.sum(cmi_term(F.col("n"), F.col("nx"), F.col("ny"), F.col("t"), F.col("t"))).alias("mi"))

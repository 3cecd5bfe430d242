"""Connected components by alternating large-star and small-star steps, each a few keyed aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from margrave.llm.common import materialize


def components(edges: DataFrame, *by: str) -> DataFrame:
    """(by, node, root) of every node in edges (by, u, v): root is the smallest node of its component. Each value of the columns
    by has a graph of its own; all graphs are worked on together.

    Every node's neighbours are replaced by stars around their minimum until nothing changes, so a node of
    enormous degree is only ever an aggregation key, never a collected list. Self-loops and nulls are ignored."""
    stars = materialize(edges.where("u <> v").select(*by, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    state = None
    while True:
        both = stars.select(*by, "u", "v").unionByName(stars.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*by, "u").agg(F.min("v").alias("m")).select(*by, "u", F.least("u", "m").alias("m"))
        # large star: larger neighbours of u point to the smallest of u and its neighbours
        large = stars.select(*by, F.col("v").alias("u"), F.col("u").alias("w")).join(least, [*by, "u"]).select(*by, F.col("w").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours point to the smallest of them
        low = large.groupBy(*by, "u").agg(F.min("v").alias("m"))
        small = large.join(low, [*by, "u"]).select(*by, F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select(*by, "e.*").where("u <> v").distinct()
        stars = materialize(small, "stars")
        now = tuple(stars.agg(F.count("*"), F.coalesce(F.sum(F.pmod(F.xxhash64(*by, "u", "v"), F.lit(1 << 40))), F.lit(0))).first())
        if now == state:
            break
        state = now
    return stars.select(*by, F.col("u").alias("node"), F.col("v").alias("root")).unionByName(stars.select(*by, F.col("v").alias("node"), F.col("v").alias("root")).distinct())

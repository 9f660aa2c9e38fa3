"""Connected components by alternating large-star and small-star steps over DataFrames; nothing goes to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialise


def _least(edges: DataFrame, u: str, v: str) -> DataFrame:
    """edges with m, the least of u and all its v: summed before it moves, so a node with many edges is no hot group."""
    m = edges.groupBy(u).agg(F.min(v).alias("m")).withColumn("m", F.least("m", u))
    return edges.join(m, u)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b); the label is the least node that it can reach."""
    e = materialise(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both, "u", "v").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v")
        small = _least(down, "u", "v")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        before, e = e, materialise(small, "edges")
        discard(e.sparkSession, before)
        new = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())

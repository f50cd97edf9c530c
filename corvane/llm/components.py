"""Connected components of an edge list by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Stored
from .common import TASK_ROWS, hot_join


def _star(edges: DataFrame, small: bool, n: int) -> DataFrame:
    """One star step; hub nodes are joined by broadcast, so their many edges stay where they are."""
    if small:
        e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        e = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = e.groupBy("u").agg(F.min("v").alias("_v"), F.count(F.lit(1)).alias("_deg")).withColumn("m", F.least("u", "_v")).drop("_v")
    if n <= TASK_ROWS:
        joined = e.join(low, "u")
    else:
        e = Stored(e, "cc-edges").df
        low = Stored(e.groupBy("u").agg(F.min("v").alias("_v"), F.count(F.lit(1)).alias("_deg")).withColumn("m", F.least("u", "_v")).drop("_v"), "cc-min").df
        joined = hot_join(e, low, ["u"], "_deg", 2 * n)
    if small:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    else:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, max_steps: int = 50) -> DataFrame:
    """(node, component): the smallest node reachable from every node that has an edge."""
    current = Stored(edges.select("u", "v").filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    n = current.df.count()
    if not n:
        return current.df.select(F.col("u").alias("node"), F.col("v").alias("component"))
    signature = None
    for _ in range(max_steps):
        large = _star(current.df, False, n)
        current = Stored(_star(Stored(large, "cc-large").df if n > TASK_ROWS else large, True, n), "cc")
        now = current.df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == signature:
            break
        signature = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return current.df.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(current.df.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

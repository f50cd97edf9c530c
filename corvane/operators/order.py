"""Order statistics, ranks and suffix minima of groups that no task should sort alone.

Equal values collapse to (value, count) before anything is dealt; the distinct
values are then dealt by range and get running counts by ``scan``, so a group of any size is
spread over range partitions. Selection reads the two values that hold a place.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.nulls import finite
from .scan import numbered, ranged, running

#: Rows of a group that one task sorts at most.
LARGE_GROUP = 1_000_000
#: A relation that the planner expects to be smaller has no such group, as a row takes 8 bytes and more.
SMALL_BYTES = 8 * LARGE_GROUP


def has_large_group(df: DataFrame, keys: Sequence[str], rows: int = LARGE_GROUP) -> bool:
    """Whether a group has more than ``rows`` rows; counted only if the planner's estimate of the relation does not rule it out."""
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SMALL_BYTES:
        return False
    most = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    return (most or 0) > rows


def beside(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Joins by keys of which NULL equals NULL; the right side's other columns follow."""
    named = right.select(*[F.col(k).alias(f"_right_{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{i}")) for i, k in enumerate(keys)], F.lit(True))
    return left.join(named, same, how).drop(*[f"_right_{i}" for i in range(len(keys))])


def value_places(df: DataFrame, keys: Sequence[str], value: str, descending: bool = False) -> DataFrame:
    """(keys, value, _n, _upto): how often each value occurs in its group, and how many rows are at or before it."""
    by = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return numbered(by, keys, [F.col(value).desc() if descending else F.col(value).asc()], {"_n": "_upto"}).drop("_row")


def percentiles(df: DataFrame, keys: Sequence[str], value: str, p: float, out: str) -> DataFrame:
    """(keys, out): exact percentile of every group by linear interpolation between order statistics; NULL without a finite value."""
    usable = df.select(*keys, finite(value).cast("double").alias("_x"))
    places = value_places(usable, keys, "_x")
    totals = places.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    at = F.lit(p) * (F.col("_total") - 1)
    low, high = F.floor(at), F.ceil(at)
    holds = lambda place: (F.col("_upto") - F.col("_n") <= place) & (place < F.col("_upto"))
    both = beside(places, totals, keys).filter(holds(low) | holds(high))
    ends = both.groupBy(*keys).agg(F.max(F.when(holds(low), F.col("_x"))).alias("_lo"), F.max(F.when(holds(high), F.col("_x"))).alias("_hi"), F.first(at).alias("_at"))
    between = (F.ceil("_at") - F.col("_at")) * F.col("_lo") + (F.col("_at") - F.floor("_at")) * F.col("_hi")
    found = ends.select(*keys, F.when(F.floor("_at") == F.ceil("_at"), F.col("_lo")).otherwise(between).alias(out))
    return beside(df.select(*keys).distinct(), found, keys) if keys else found


def ranks(df: DataFrame, keys: Sequence[str], value: str, descending: bool = False) -> DataFrame:
    """Adds _first (1 + rows before the value) and _ties (rows of the value); NULL for a NULL value."""
    places = value_places(df, keys, value, descending)
    return beside(df, places.select(*keys, value, (F.col("_upto") - F.col("_n") + 1).alias("_first"), F.col("_n").alias("_ties")), [*keys, value])


def group_sizes(df: DataFrame, keys: Sequence[str], count: Column, out: str) -> DataFrame:
    """Adds an aggregate of the group to its rows, by an aggregation and a join in place of a window."""
    sizes = df.groupBy(*keys).agg(count.alias(out))
    return beside(df, sizes, keys)


def suffix_minimum(df: DataFrame, keys: Sequence[str], value: str, raw: Column, count: str, out: str) -> DataFrame:
    """(keys, value, out): the smallest ``raw`` at this distinct value or behind it in ascending order; ``raw`` may use ``_upto``, the running sum of ``count``."""
    order = [F.col(value).asc()]
    upto = running(ranged(df, keys, order, "suffix").df, order, {count: "_upto"}).withColumn("_raw", raw)
    here = W.partitionBy("_part", "_key").orderBy(F.col(value).desc()).rowsBetween(W.unboundedPreceding, 0)
    behind = W.partitionBy("_key").orderBy(F.col("_part").desc()).rowsBetween(W.unboundedPreceding, -1)
    parts = upto.groupBy("_part", "_key").agg(F.min("_raw").alias("_least"))
    later = parts.select("_part", "_key", F.min("_least").over(behind).alias("_later"))
    local = upto.withColumn("_local", F.min("_raw").over(here))
    return local.join(later, ["_part", "_key"]).select(*keys, value, F.least("_local", "_later").alias(out))

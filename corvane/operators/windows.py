"""Positional windows, shifts, runs and spaced selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .order import has_large_group
from .scan import key_text, numbered, with_halo


#: Rows of a series that one task sorts at most.
SERIES_BLOCK = 1 << 20


def sliding_mean(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], width: int, suffix: str = "_mean", spread: bool | None = None, block: int = SERIES_BLOCK) -> DataFrame:
    """Mean of a row and the width-1 next ones; incomplete frames are dropped, a missing member gives NULL.

    A series too long for one task is numbered over range partitions and cut into blocks, each with
    the rows that its last frames look ahead to; ``spread`` decides for the caller.
    """
    spread = has_large_group(df, keys) if spread is None else spread
    if spread:
        block = max(block, width)
        rows = with_halo(numbered(df, keys, [F.col(order).asc()]), "_row", block, width - 1).withColumn("_series", key_text(keys))
        w = W.partitionBy("_series", "_block").orderBy("_row").rowsBetween(0, width - 1)
    else:
        rows, w = df, W.partitionBy(*keys).orderBy(order).rowsBetween(0, width - 1)
    out = rows.withColumns({f"{v}{suffix}": F.when(F.count(v).over(w) == width, F.avg(v).over(w)) for v in values})
    whole = out.withColumn("_n", F.count(F.lit(1)).over(w)).filter(F.col("_n") == width).drop("_n")
    return whole.filter("_own").drop("_own", "_block", "_row", "_series") if spread else whole


def run_starts(df: DataFrame, keys: Sequence[str], order: str, label: str) -> DataFrame:
    """First row of every run of equal labels."""
    prev = F.lag(label).over(W.partitionBy(*keys).orderBy(order))
    return df.withColumn("_prev", prev).withColumn("_first", F.row_number().over(W.partitionBy(*keys).orderBy(order)) == 1).filter(F.col("_first") | ~F.col("_prev").eqNullSafe(F.col(label))).drop("_prev", "_first")


def interval_faults(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Adjacent intervals that overlap or leave a gap."""
    prev = F.lag(end).over(W.partitionBy(*keys).orderBy(start))
    kind = F.when(F.col(start) <= F.col("previous_end"), "overlap").when(F.col(start) > F.col("previous_end") + 1, "gap")
    return df.withColumn("previous_end", prev).withColumn("fault", kind).filter(F.col("fault").isNotNull())


def circular_shift(df: DataFrame, bin_col: str, n: Column, k: Column, out: str) -> DataFrame:
    """Bin after rolling by k positions; the last wrap to the front."""
    return df.withColumn(out, F.pmod(F.col(bin_col) + k, n))


def allowed_shifts(n: Column, exclusion: int) -> Column:
    """Shifts farther than ``exclusion`` from either end; if there are none, all non-zero shifts."""
    every = F.when(n > 1, F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    preferred = F.filter(every, lambda s: F.least(s, n.cast("int") - s) > exclusion)
    return F.when(F.size(preferred) > 0, preferred).otherwise(every)


def bin_of_midpoint(start: Column, length: Column, width: int) -> Column:
    """Bin of an interval's midpoint."""
    return F.floor((start + (length - 1) / F.lit(2.0)) / F.lit(float(width)))


def spaced_selection(df: DataFrame, keys: Sequence[str], bin_col: str, score: str, separation: int, minimum: int = 3, p: float = 0.9) -> DataFrame:
    """Greedy peaks: best score first, each farther than ``separation`` bins from all kept.

    Only positive scores at or above the percentile ``p`` of the positive ones
    stand; fewer than ``minimum`` positive scores or kept peaks give none. The
    fold runs over one group's candidates, at most a tenth of its bins.
    """
    positive = F.when(F.col(score) > 0, F.col(score))
    threshold = df.groupBy(*keys).agg(F.percentile(positive, p).alias("threshold"), F.count(positive).alias("n_positive"))
    stand = df.join(threshold, list(keys)).filter((F.col(score) > 0) & (F.col(score) >= F.col("threshold")) & (F.col("n_positive") >= minimum))
    item = F.struct((-F.col(score)).alias("o"), F.col(bin_col).cast("long").alias("b"))
    agg = stand.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_c"), F.first("threshold").alias("threshold"))
    kept = F.aggregate(
        "_c",
        F.array().cast("array<bigint>"),
        lambda acc, x: F.when(F.forall(acc, lambda b: F.abs(b - x["b"]) > separation), F.array_append(acc, x["b"])).otherwise(acc),
    )
    return agg.withColumn("_k", kept).filter(F.size("_k") >= minimum).select(*keys, "threshold", F.explode("_k").alias(bin_col))

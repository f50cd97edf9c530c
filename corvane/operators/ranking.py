"""Ranks, percentiles and top-k selections within groups. Every order has an explicit tie-break.

With ``spread`` ranks come from range partitions (``operators.order``) and no task sorts a group;
without it from a window. By default the groups' sizes decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .order import group_sizes, has_large_group, ranks
from .scan import numbered


def _order(col: str, descending: bool) -> Column:
    return F.col(col).desc_nulls_last() if descending else F.col(col).asc_nulls_last()


def competition_rank(df: DataFrame, keys: list[str], value: str, out: str, descending: bool = True, spread: bool | None = None) -> DataFrame:
    """Rank 1,2,2,4; NULL for a NULL value."""
    if has_large_group(df, keys) if spread is None else spread:
        return ranks(df, keys, value, descending).withColumn(out, F.col("_first").cast("long")).drop("_first", "_ties")
    rank = F.rank().over(W.partitionBy(*keys).orderBy(_order(value, descending)))
    return df.withColumn(out, F.when(F.col(value).isNotNull(), rank.cast("long")))


def average_rank(df: DataFrame, keys: list[str], value: str, out: str, descending: bool = False, spread: bool | None = None) -> DataFrame:
    """Ties share the mean of their ranks; NULL for a NULL value."""
    if has_large_group(df, keys) if spread is None else spread:
        return ranks(df, keys, value, descending).withColumn(out, F.col("_first") + (F.col("_ties") - 1) / F.lit(2.0)).drop("_first", "_ties")
    first = F.rank().over(W.partitionBy(*keys).orderBy(_order(value, descending)))
    ties = F.count(F.lit(1)).over(W.partitionBy(*keys, value))
    return df.withColumn(out, F.when(F.col(value).isNotNull(), first + (ties - 1) / F.lit(2.0)))


def favourable_percentile(df: DataFrame, keys: list[str], value: str, out: str, descending: bool = False, spread: bool | None = None) -> DataFrame:
    """(average rank - 0.5) / n over the non-NULL values of a group."""
    spread = has_large_group(df, keys) if spread is None else spread
    ranked = average_rank(df, keys, value, "_avg", descending, spread)
    if spread:
        return group_sizes(ranked, keys, F.count(value), "_n").withColumn(out, (F.col("_avg") - 0.5) / F.col("_n")).drop("_avg", "_n")
    n = F.count(value).over(W.partitionBy(*keys))
    return ranked.withColumn(out, (F.col("_avg") - 0.5) / n).drop("_avg")


def top_flags(df: DataFrame, rank: str, ks: tuple[int, ...] = (1, 3)) -> DataFrame:
    """Columns top1, top3, ... as 0/1; NULL where the rank is NULL."""
    return df.withColumns({f"top{k}": (F.col(rank) <= k).cast("long") for k in ks})


def top_fraction(df: DataFrame, keys: list[str], score: str, tie: str, fraction: float, out: str = "in_top", spread: bool | None = None) -> DataFrame:
    """Marks the ceil(fraction * n) best rows of a group; equal scores go by ``tie`` ascending."""
    if has_large_group(df, keys) if spread is None else spread:
        placed = group_sizes(numbered(df, keys, [F.col(score).desc_nulls_last(), F.col(tie).asc()]), keys, F.count(F.lit(1)), "_n")
        return placed.withColumn(out, F.col("_row") <= F.ceil(F.lit(fraction) * F.col("_n"))).drop("_row", "_n")
    row = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last(), F.col(tie)))
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    return df.withColumn(out, row <= F.ceil(F.lit(fraction) * n))


def top_share_and_lift(df: DataFrame, keys: list[str], score: str, tie: str, amount: str, fraction: float = 0.1) -> DataFrame:
    """Share of an amount held by the best rows, and that share over their share of the rows."""
    marked = top_fraction(df, keys, score, tie, fraction)
    agg = marked.groupBy(*keys).agg(
        F.sum(F.when(F.col("in_top"), F.col(amount))).alias("top_amount"),
        F.sum(amount).alias("amount"),
        F.count_if("in_top").alias("n_top"),
        F.count(F.lit(1)).alias("n"),
    )
    share = F.try_divide(F.col("top_amount").cast("double"), F.col("amount").cast("double"))
    return agg.withColumn("top_share", share).withColumn("lift", F.try_divide(F.col("top_share"), F.col("n_top") / F.col("n")))


def top_bottom_padded(df: DataFrame, feature: str, score: str, tie: str, k: int, features: DataFrame | None = None) -> DataFrame:
    """k best and k worst rows of every feature, padded with NULL rows; equal scores go to the lower ``tie``.

    ``features`` gives features that must appear even without rows.
    """
    ends = []
    for side, order in (("top", F.col(score).desc_nulls_last()), ("bottom", F.col(score).asc_nulls_last())):
        row = F.row_number().over(W.partitionBy(feature).orderBy(order, F.col(tie)))
        ends.append(df.filter(F.col(score).isNotNull()).withColumn("place", row).filter(F.col("place") <= k).withColumn("side", F.lit(side)))
    found = ends[0].unionByName(ends[1])
    names = (features or df).select(feature).distinct()
    grid = names.select(feature, F.explode(F.array(F.lit("top"), F.lit("bottom"))).alias("side")).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("place")
    )
    return grid.join(found, [feature, "side", "place"], "left")


def arg_max_flag(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """1 for the largest value of a group, ties included."""
    return df.withColumn(out, (F.col(value) == F.max(value).over(W.partitionBy(*keys))).cast("long"))

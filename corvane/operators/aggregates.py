"""Grouped summaries. NULL and non-finite values never enter an aggregate.

Medians and percentiles of groups that one task should not gather are selected over range
partitions (``operators.order``); by default the groups' sizes decide, ``spread`` decides for the caller.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.nulls import finite
from .order import beside, has_large_group, percentiles


def median_of(df: DataFrame, keys: Sequence[str], values: dict[str, str], spread: bool | None = None) -> DataFrame:
    """Median (linear interpolation) of each ``column -> name`` by group."""
    if has_large_group(df, keys) if spread is None else spread:
        first, *others = [percentiles(df, keys, c, 0.5, n) for c, n in values.items()]
        for one in others:
            first = beside(first, one, keys)
        return first
    return df.groupBy(*keys).agg(*[F.median(finite(c)).alias(n) for c, n in values.items()])


def balanced_median(df: DataFrame, levels: Sequence[Sequence[str]], value: str, out: str | None = None, spread: bool | None = None) -> DataFrame:
    """Median of medians: one grouping per level, each over the medians of the level before.

    Groups whose values are all missing drop out before the next level, so
    they carry no weight. The last level also counts its members (``n_members``)
    and the members without a value (``n_undefined``).
    """
    out = out or value
    current, column = df, value
    for depth, keys in enumerate(levels):
        last = depth == len(levels) - 1
        counts = [F.count(finite(column)).alias("n_members"), F.count_if(finite(column).isNull()).alias("n_undefined")] if last else []
        if has_large_group(current, keys) if spread is None else spread:
            medians = percentiles(current, keys, column, 0.5, "_median")
            current = beside(current.groupBy(*keys).agg(*counts), medians, keys) if last else medians
            current = current.select(*keys, F.col("_median").alias("_m"), *(["n_members", "n_undefined"] if last else []))
        else:
            current = current.groupBy(*keys).agg(F.median(finite(column)).alias("_m"), *counts)
        column = "_m"
    return current.withColumnRenamed("_m", out)


def percentile_of(df: DataFrame, keys: Sequence[str], value: str, p: float, out: str, spread: bool | None = None) -> DataFrame:
    """Exact percentile, linear interpolation between order statistics."""
    if has_large_group(df, keys) if spread is None else spread:
        return percentiles(df, keys, value, p, out)
    return df.groupBy(*keys).agg(F.percentile(finite(value), p).alias(out))


def rounded_mean(value: str, digits: int) -> Column:
    """Mean of decimal figures held in doubles, rounded half up.

    A sum of doubles hangs on the order of its rows, which decides means that lie halfway between
    two figures. Decimals sum alike in every order; what they cannot hold is summed in doubles.
    """
    held = F.col(value).try_cast("decimal(24,10)")
    exact = F.round(F.try_avg(held), digits).cast("double")
    return F.when(F.count(held) == F.count(value), exact).otherwise(F.round(F.avg(value), digits))


def pooled_ratio(df: DataFrame, keys: Sequence[str], observed: str, expected: str, total: str) -> DataFrame:
    """sum(observed)/sum(total), sum(total*expected)/sum(total) and their ratio, over rows with a total and an expectation."""
    usable = df.filter((F.col(total) > 0) & F.col(expected).isNotNull())
    agg = usable.groupBy(*keys).agg(
        F.sum(observed).cast("double").alias("_o"), F.sum(total).cast("double").alias("_t"), F.sum(F.col(total) * F.col(expected)).alias("_e")
    )
    return agg.select(
        *keys,
        F.try_divide("_o", "_t").alias("pooled_observed"),
        F.try_divide("_e", "_t").alias("pooled_expected"),
        F.try_divide("_o", "_e").alias("pooled_ratio"),
    )


def dense_grid(df: DataFrame, entities: DataFrame, axes: dict[str, Sequence | DataFrame], fill: dict[str, object]) -> DataFrame:
    """A row for every entity and every combination of the axes; absent measures get ``fill``.

    Axes are short literal lists (exploded beside each entity, no join) or
    one-column frames of observed values.
    """
    grid = entities
    for name, values in axes.items():
        if isinstance(values, DataFrame):
            grid = grid.crossJoin(F.broadcast(values.select(name).distinct()))
        else:
            grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    keys = [*entities.columns, *axes]
    return grid.join(df, keys, "left").fillna(fill)


def share_of_total(df: DataFrame, keys: Sequence[str], value: str, out: str, total: str | None = None) -> DataFrame:
    """Value over its group's sum; NULL for an empty group. ``total`` keeps the sum."""
    s = F.sum(value).over(W.partitionBy(*keys))
    df = df.withColumn(out, F.try_divide(F.col(value).cast("double"), s.cast("double")))
    return df.withColumn(total, s) if total else df


def mode_with_ties(df: DataFrame, keys: Sequence[str], items: Sequence[str], weight: str) -> DataFrame:
    """The heaviest item; ties give the smallest item, and how many tied."""
    top = F.max(weight).over(W.partitionBy(*keys))
    best = df.withColumn("_top", top).filter(F.col(weight) == F.col("_top"))
    agg = best.groupBy(*keys).agg(F.min(F.struct(*items)).alias("_item"), F.count(F.lit(1)).alias("n_tied"), F.max(weight).alias(weight))
    return agg.select(*keys, *[F.col(f"_item.{c}").alias(c) for c in items], weight, "n_tied")


def distinct_weight(df: DataFrame, keys: Sequence[str], identity: str) -> DataFrame:
    """Each distinct identity of a group counts once."""
    return df.groupBy(*keys).agg(F.countDistinct(identity).alias("n_unique"))


def collapse(df: DataFrame, keys: Sequence[str], identity: str, amount: str) -> DataFrame:
    """Amounts of equal identities summed."""
    return df.groupBy(*keys, identity).agg(F.sum(amount).alias(amount))


def sum_deviation(df: DataFrame, keys: Sequence[str], value: str, target: float = 1.0) -> DataFrame:
    """Largest distance of a group's sum from the target: one row."""
    return df.groupBy(*keys).agg(F.sum(value).alias("_s")).agg(F.max(F.abs(F.col("_s") - target)).alias("max_deviation"))


def accounting(df: DataFrame, reasons: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """Row counts: examined, retained, and excluded by the first reason that holds."""
    chain: Column | None = None
    for name, cond in reasons.items():
        chain = F.when(cond, F.lit(name)) if chain is None else chain.when(cond, F.lit(name))
    marked = df.withColumn("_r", chain) if chain is not None else df.withColumn("_r", F.lit(None).cast("string"))
    counts = [F.count(F.lit(1)).alias("examined"), F.count_if(F.col("_r").isNull()).alias("retained")]
    counts += [F.count_if(F.col("_r") == n).alias(f"excluded_{n}") for n in reasons]
    return marked.groupBy(*keys).agg(*counts)


def text_set(column: str, sep: str = ",") -> Column:
    """Sorted distinct values of a group as text."""
    return F.array_join(F.array_sort(F.collect_set(column)), sep)


def contrast_of_signs(value: str, sign: str) -> Column:
    """Mean where the sign is positive minus mean where it is negative."""
    return F.avg(F.when(F.col(sign) > 0, F.col(value))) - F.avg(F.when(F.col(sign) < 0, F.col(value)))


def unpivot_metrics(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Metric columns to (metric, value) rows."""
    return df.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(list(ids), list(metrics), "metric", "value")


def pivot_sums(df: DataFrame, keys: Sequence[str], by: str, levels: Sequence, value: str, prefix: str) -> DataFrame:
    """Conditional sums, one column per level; a single aggregation, absent levels 0."""
    return df.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col(by) == v, F.col(value))), F.lit(0)).alias(f"{prefix}{v}") for v in levels])

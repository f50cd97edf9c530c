"""Length landscape and fixed strand composition of reads (sample, unit, strand, length, count, identity)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import safe_ratio
from ..operators import aggregates as A
from ..operators import ranking as R

PAIR = ["sample", "unit"]
#: Names of the two weightings (fixed values).
MODES = ["abundance", "unique_sequence"]


def by_strand(reads: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """Abundance and distinct sequences per pair, length and strand."""
    kept = reads.filter(F.col("length").isin(*lengths))
    return kept.groupBy(*PAIR, "length", "strand").agg(F.sum("count").alias("abundance"), F.countDistinct("identity").alias("unique_sequence"))


def length_pairs(reads: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """Dense share, competition rank and top flags of every length in every pair, for both weightings."""
    counts = by_strand(reads, lengths).groupBy(*PAIR, "length").agg(*[F.sum(m).alias(m) for m in MODES])
    dense = A.dense_grid(counts, counts.select(*PAIR).distinct(), {"length": [int(v) for v in lengths]}, dict.fromkeys(MODES, 0))
    long = dense.unpivot([*PAIR, "length"], MODES, "mode", "n")
    shared = A.share_of_total(long, [*PAIR, "mode"], "n", "fraction", "total")
    ranked = R.competition_rank(shared, [*PAIR, "mode"], "n", "rank")
    return R.top_flags(ranked.withColumn("rank", F.when(F.col("total") > 0, F.col("rank"))), "rank").drop("total")


def length_samples(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("fraction").isNotNull()).groupBy("sample", "length", "mode").agg(
        F.median("fraction").alias("fraction"), F.median("rank").alias("rank"), F.count("fraction").alias("n_units")
    )


def length_dataset(pairs: DataFrame) -> DataFrame:
    """Median of sample medians, and how often a length ranks first or among three."""
    top = length_samples(pairs).groupBy("length", "mode").agg(
        F.median("fraction").alias("fraction"), F.median("rank").alias("rank"), F.count("fraction").alias("n_samples")
    )
    rates = pairs.groupBy("length", "mode").agg(F.avg("top1").alias("top1_rate"), F.avg("top3").alias("top3_rate"), F.count("rank").alias("n_pairs"))
    return top.join(rates, ["length", "mode"])


#: Metrics of the fixed composition (fixed values).
COMPOSITION = ["sense_low", "antisense_low", "sense_high", "antisense_high", "antisense_delta", "low_share", "high_share"]


def composition_pairs(reads: DataFrame, low: int, high: int) -> DataFrame:
    """Strand shares at two lengths, their antisense difference, and the lengths' shares of both."""
    long = by_strand(reads, [low, high]).unpivot([*PAIR, "length", "strand"], MODES, "mode", "n")
    cell = lambda length, strand: F.coalesce(F.sum(F.when((F.col("length") == length) & (F.col("strand") == strand), F.col("n"))), F.lit(0))
    wide = long.groupBy(*PAIR, "mode").agg(
        cell(low, "sense").alias("ls"), cell(low, "antisense").alias("la"), cell(high, "sense").alias("hs"), cell(high, "antisense").alias("ha")
    )
    n_low, n_high = F.col("ls") + F.col("la"), F.col("hs") + F.col("ha")
    return wide.select(
        *PAIR, "mode",
        safe_ratio(F.col("ls"), n_low).alias("sense_low"), safe_ratio(F.col("la"), n_low).alias("antisense_low"),
        safe_ratio(F.col("hs"), n_high).alias("sense_high"), safe_ratio(F.col("ha"), n_high).alias("antisense_high"),
        (safe_ratio(F.col("ha"), n_high) - safe_ratio(F.col("la"), n_low)).alias("antisense_delta"),
        safe_ratio(n_low, n_low + n_high).alias("low_share"), safe_ratio(n_high, n_low + n_high).alias("high_share"),
    )


def composition_balanced(pairs: DataFrame) -> DataFrame:
    """Sample-balanced and pair-balanced medians of every composition metric."""
    long = A.unpivot_metrics(pairs, [*PAIR, "mode"], COMPOSITION)
    sample = A.balanced_median(long, [["mode", "metric", "sample"], ["mode", "metric"]], "value", "sample_balanced")
    pair = long.groupBy("mode", "metric").agg(F.median("value").alias("pair_balanced"), F.count("value").alias("n_pairs"))
    return sample.join(pair, ["mode", "metric"])

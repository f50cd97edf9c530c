"""Clustered bootstraps whose groups never lie in one task: draws are counted per replicate and joined to numbered values.

A replicate is a multiset of places. Places are drawn once for each distinct
number of clusters, as (n, replicate, place, times), and meet the numbered
cluster medians in a join; the median of a replicate is a median weighted by
``times``. A task holds at most one replicate's medians, never rows of the input.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import finite
from .aggregates import median_of
from .order import beside
from .scan import numbered


def _replicates(n: int, replicates: int, seed: int, rng: str) -> Iterator[np.ndarray]:
    """The drawn places of one replicate after the other, as ``resampling.index_matrix`` has them in its rows."""
    if rng == "mt19937":
        r = random.Random(seed)
        yield from (np.fromiter((r.choice(range(n)) for _ in range(n)), np.int64, n) for _ in range(replicates))
    elif rng == "pcg64":
        g = np.random.default_rng(seed)
        yield from (g.integers(0, n, n) for _ in range(replicates))
    elif rng == "hash":
        yield from (np.fromiter((int(hashlib.sha256(f"{b}|{i}".encode()).hexdigest()[:8], 16) % n for i in range(n)), np.int64, n) for b in range(replicates))
    else:
        raise ValueError(f"unknown rng: {rng}")


def draw_table(sizes: DataFrame, n: str, replicates: int, seed: int = 0, rng: str = "hash") -> DataFrame:
    """(n, replicate, place, times): how often each place below n is drawn in n draws; each distinct size is drawn once.

    A generator is sequential, so a size is drawn by one task, which holds one replicate at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for size in b["n"]:
                for i, picks in enumerate(_replicates(int(size), replicates, seed, rng)):
                    place, times = np.unique(picks, return_counts=True)
                    yield pd.DataFrame({"n": size, "replicate": i, "place": place, "times": times})

    distinct = sizes.select(F.col(n).cast("long").alias("n")).filter("n > 0").distinct()
    return distinct.mapInPandas(run, "n long, replicate int, place long, times long")


def _interval(estimates: DataFrame, keys: Sequence[str], level: float) -> DataFrame:
    tail = (1 - level) / 2
    return estimates.groupBy(*keys).agg(F.percentile("_e", tail).alias("ci_low"), F.percentile("_e", 1 - tail).alias("ci_high"), F.count("_e").alias("replicates"))


def clustered_median_ci(df: DataFrame, keys: Sequence[str], cluster: str, value: str, replicates: int = 1000, seed: int = 0, rng: str = "hash", level: float = 0.95) -> DataFrame:
    """Percentile interval of the median of cluster medians, clusters drawn with replacement in sorted order.

    Gives what ``resampling.bootstrap_median_ci`` gives, without collecting a group: (keys, estimate, ci_low, ci_high,
    replicates, n_clusters). Missing values are left out, clusters and groups without a value too. NULL keys
    are a group, a NULL cluster is one that sorts first.
    """
    medians = median_of(df, [*keys, cluster], {value: "_m"}).filter(F.col("_m").isNotNull())
    placed = numbered(medians, keys, [F.col(cluster).asc_nulls_first()]).withColumn("_place", F.col("_row") - 1)
    sizes = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_clusters"), F.median("_m").alias("estimate"))
    draws = draw_table(sizes, "n_clusters", replicates, seed, rng)
    values = beside(placed.select(*keys, "_place", "_m"), sizes.select(*keys, "n_clusters"), keys)
    drawn = values.join(draws, (F.col("n_clusters") == F.col("n")) & (F.col("_place") == F.col("place")))
    estimates = drawn.groupBy(*keys, "replicate").agg(F.percentile("_m", 0.5, F.col("times")).alias("_e"))
    return beside(sizes.select(*keys, "estimate", "n_clusters"), _interval(estimates, keys, level), keys).select(*keys, "estimate", "ci_low", "ci_high", "replicates", "n_clusters")


def median_places(n: int, seed: int) -> tuple[int, int]:
    """Places (from 0) of the two middle values among n draws with replacement from n sorted values.

    The middle order statistics of n uniforms are beta-distributed, so they are drawn at once instead of from n draws.
    """
    r = np.random.default_rng(seed)
    m = (n + 1) // 2
    low = r.beta(m, n - m + 1)
    high = low if n % 2 else low + (1 - low) * r.beta(1, n - m)
    return min(int(low * n), n - 1), min(int(high * n), n - 1)


def hierarchical_median_ci(df: DataFrame, keys: Sequence[str], cluster: str, value: str, replicates: int = 500, seed: int = 0, level: float = 0.95) -> DataFrame:
    """Clusters drawn with replacement, then rows within each drawn cluster; interval of the median of medians, for clusters of any size.

    The law is that of ``resampling.hierarchical_bootstrap_ci``, the draws are others: each comes from the digest of (seed, keys,
    replicate, draw), so that it does not depend on how rows are dealt. Rows are ranked within their cluster over
    range partitions; a drawn cluster looks up its two middle places. (keys, ci_low, ci_high, replicates,
    n_clusters); groups without a finite value are left out. Replicates times clusters rows are shuffled, twice.
    """
    rows = df.select(*keys, F.col(cluster).alias("_c"), finite(value).alias("_v")).filter(F.col("_v").isNotNull())
    ranked = numbered(rows, [*keys, "_c"], [F.col("_v").asc()]).select(*keys, "_c", (F.col("_row") - 1).alias("_place"), "_v")
    clusters = numbered(rows.groupBy(*keys, "_c").agg(F.count(F.lit(1)).alias("_size")), keys, [F.col("_c").asc_nulls_first()])
    sizes = clusters.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_clusters"))
    # one row a replicate and cluster; the cluster's number serves as the number of the draw
    draws = beside(clusters.select(*keys, F.col("_row").alias("_draw")), sizes, keys).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    text = F.concat_ws("\x1f", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys], F.col("_b").cast("string"), F.col("_draw").cast("string"))
    part = lambda start: F.conv(F.substring(F.col("_hash"), start, 13), 16, 10).cast("long")
    picked = draws.withColumn("_hash", F.sha2(text, 256)).select(*keys, "_b", "_draw", (part(1) % F.col("n_clusters") + 1).alias("_row"), part(14).alias("_seed"))
    sized = beside(picked, clusters.select(*keys, "_row", "_c", "_size"), [*keys, "_row"])

    @F.pandas_udf("array<long>")
    def places(n: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([median_places(int(a), int(b)) for a, b in zip(n, s, strict=True)])

    looked = sized.withColumn("_place", F.explode(places("_size", "_seed"))).select(*keys, "_b", "_draw", "_c", "_place")
    found = beside(looked, ranked, [*keys, "_c", "_place"])
    medians = found.groupBy(*keys, "_b", "_draw").agg(F.avg("_v").alias("_m"))
    estimates = medians.groupBy(*keys, "_b").agg(F.median("_m").alias("_e"))
    return beside(sizes, _interval(estimates, keys, level), keys).select(*keys, "ci_low", "ci_high", "replicates", "n_clusters")

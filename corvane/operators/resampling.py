"""Bootstraps and permutation nulls.

``rng="hash"`` draws indices from SHA-256 of (replicate, draw), which any SQL
engine can repeat; ``rng="mt19937"`` follows Python's ``random.Random`` and
``rng="pcg64"`` NumPy's default generator. Only group values (one per cluster)
reach a task, never rows of the input.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stable_seed(seed: int, *parts: object) -> int:
    """Seed of one key, independent of the order in which keys come: eight digest bytes of its parts, joined by the unit separator."""
    digest = hashlib.sha256("\x1f".join(map(str, parts)).encode()).digest()
    return (seed + int.from_bytes(digest[:8], "big")) % (2**63 - 1)


def index_matrix(n: int, replicates: int, seed: int, rng: str) -> np.ndarray:
    """replicates x n draws from range(n)."""
    if rng == "mt19937":
        r = random.Random(seed)
        return np.array([[r.choice(range(n)) for _ in range(n)] for _ in range(replicates)])
    if rng == "pcg64":
        r = np.random.default_rng(seed)
        return np.stack([r.integers(0, n, n) for _ in range(replicates)])
    if rng == "hash":
        return np.array([[int(hashlib.sha256(f"{b}|{i}".encode()).hexdigest()[:8], 16) % n for i in range(n)] for b in range(replicates)])
    raise ValueError(f"unknown rng: {rng}")


def bootstrap_median_ci(df: DataFrame, keys: Sequence[str], cluster: str, value: str, replicates: int = 1000, seed: int = 0, rng: str = "hash", level: float = 0.95) -> DataFrame:
    """Percentile interval of the median of cluster medians, clusters drawn with replacement in sorted order.

    One draw table serves all groups of equal size: each starts from the same seed.
    """
    medians = df.groupBy(*keys, cluster).agg(F.median(value).alias("_m")).filter(F.col("_m").isNotNull())
    arrays = medians.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(cluster, "_m"))).alias("_a")).withColumn("_v", F.transform("_a", lambda s: s["_m"]))
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    draws: dict[int, np.ndarray] = {}

    @F.pandas_udf("estimate double, ci_low double, ci_high double, n_clusters long")
    def interval(values: pd.Series) -> pd.DataFrame:
        rows = []
        for v in values:
            v = np.asarray(v, dtype=float)
            if len(v) not in draws:
                draws[len(v)] = index_matrix(len(v), replicates, seed, rng)
            est = np.median(v[draws[len(v)]], axis=1)
            rows.append((float(np.median(v)), float(np.quantile(est, lo)), float(np.quantile(est, hi)), len(v)))
        return pd.DataFrame(rows, columns=["estimate", "ci_low", "ci_high", "n_clusters"])

    return arrays.select(*keys, interval("_v").alias("_r")).select(*keys, "_r.*")


def bootstrap_median_ci_sql(df: DataFrame, keys: Sequence[str], value: str, order: str, replicates: int, level: float = 0.95) -> DataFrame:
    """The hash bootstrap with built-in expressions only: draws, lookups and medians stay in the JVM."""
    arrays = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("_a"))
    sized = arrays.withColumn("_v", F.transform("_a", lambda s: s[value])).withColumn("_n", F.size("_a"))
    reps = sized.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    digest = F.sha2(F.concat(F.col("_b").cast("string"), F.lit("|"), F.col("_i").cast("string")), 256)
    pick = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.col("_n")
    drawn = reps.select(*keys, "_b", F.get("_v", pick.cast("int")).alias("_x"))
    est = drawn.groupBy(*keys, "_b").agg(F.median("_x").alias("_e"))
    return est.groupBy(*keys).agg(F.percentile("_e", (1 - level) / 2).alias("ci_low"), F.percentile("_e", 1 - (1 - level) / 2).alias("ci_high"), F.count(F.lit(1)).alias("replicates"))


def hierarchical_bootstrap_ci(df: DataFrame, keys: Sequence[str], cluster: str, value: str, replicates: int = 500, seed: int = 0, level: float = 0.95) -> DataFrame:
    """Clusters drawn with replacement, then rows within each drawn cluster; median of medians. Seeded per key."""
    spec = ", ".join(f"{k} {t}" for k, t in df.dtypes if k in keys)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        groups = [g.to_numpy(float) for _, g in pdf.dropna(subset=[value]).sort_values([cluster, value]).groupby(cluster)[value]]
        if not groups:
            return pd.DataFrame([(*key, None, None, 0)], columns=[*keys, "ci_low", "ci_high", "replicates"])
        r = np.random.default_rng(stable_seed(seed, *key))
        est = []
        for _ in range(replicates):
            drawn = r.integers(0, len(groups), len(groups))
            est.append(np.median([np.median(groups[c][r.integers(0, len(groups[c]), len(groups[c]))]) for c in drawn]))
        a = (1 - level) / 2
        return pd.DataFrame([(*key, np.quantile(est, a), np.quantile(est, 1 - a), len(est))], columns=[*keys, "ci_low", "ci_high", "replicates"])

    return df.select(*keys, cluster, value).groupBy(*keys).applyInPandas(run, f"{spec}, ci_low double, ci_high double, replicates int")


def generator_draws(lengths: DataFrame, keys: Sequence[str], n: str, replicates: int, exclusion: int, seed: int) -> DataFrame:
    """(keys, replicate, shift) from NumPy's default generator, seeded per key: the draws of a run that used it, for ``shifts.shift_null``.

    A task holds one key's replicates, never its series.
    """
    spec = ", ".join(f"{k} {t}" for k, t in lengths.dtypes if k in keys)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        size = int(pdf[n].iloc[0])
        first, last = (exclusion + 1, size - exclusion - 1) if size - 1 > 2 * exclusion else (1, size - 1)
        drawn = np.random.default_rng(stable_seed(seed, *key)).choice(np.arange(first, last + 1), replicates) if size > 1 else np.zeros(0, int)
        return pd.DataFrame([(*key, i, int(x)) for i, x in enumerate(drawn)], columns=[*keys, "replicate", "shift"])

    return lengths.groupBy(*keys).applyInPandas(run, f"{spec}, replicate int, shift long")

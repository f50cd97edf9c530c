"""Weighted least squares with absorbed group effects, from one aggregation pass."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .ranking import top_share_and_lift
from .statistics import spearman


def sample_weights(df: DataFrame, sample: str, group: str, fold: Sequence[str] = (), out: str = "weight") -> DataFrame:
    """Weights that give every sample, and every group in it, the same say: raw = 1 / (groups of the sample * rows of the group), scaled to mean 1."""
    sizes = df.groupBy(*fold, sample, group).agg(F.count(F.lit(1)).alias("_rows"))
    per = W.partitionBy(*fold, sample)
    raw = sizes.withColumn("_raw", 1.0 / (F.count(F.lit(1)).over(per) * F.col("_rows")))
    total = raw.groupBy(*fold).agg(F.sum("_rows").alias("_n"), F.sum(F.col("_raw") * F.col("_rows")).alias("_s"))
    scaled = (raw.join(total, list(fold)) if fold else raw.crossJoin(F.broadcast(total))).select(*fold, sample, group, (F.col("_n") * F.col("_raw") / F.col("_s")).alias(out))
    return df.join(scaled, [*fold, sample, group])


def centre(df: DataFrame, keys: Sequence[str], columns: Sequence[str], weight: str, suffix: str = "_c") -> DataFrame:
    """Columns minus their weighted group mean."""
    means = df.groupBy(*keys).agg(*[F.try_divide(F.sum(F.col(weight) * F.col(c)), F.sum(weight)).alias(f"_m_{c}") for c in columns])
    joined = df.join(means, list(keys))
    return joined.withColumns({f"{c}{suffix}": F.col(c) - F.col(f"_m_{c}") for c in columns}).drop(*[f"_m_{c}" for c in columns])


def moments(df: DataFrame, y: str, xs: Sequence[str], weight: str, keys: Sequence[str] = ()) -> DataFrame:
    """Weighted cross products of the design and the response: one row per key."""
    terms = {f"xx_{i}_{j}": F.sum(F.col(weight) * F.col(xs[i]) * F.col(xs[j])) for i in range(len(xs)) for j in range(i, len(xs))}
    terms |= {f"xy_{i}": F.sum(F.col(weight) * F.col(x) * F.col(y)) for i, x in enumerate(xs)}
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in terms.items()], F.count(F.lit(1)).alias("n"))


def solve(row, xs: Sequence[str]) -> dict[str, float]:
    """Coefficients from one row of moments; a singular design is an error."""
    k = len(xs)
    a, b = np.zeros((k, k)), np.zeros(k)
    for i in range(k):
        b[i] = row[f"xy_{i}"]
        for j in range(i, k):
            a[i, j] = a[j, i] = row[f"xx_{i}_{j}"]
    if np.linalg.matrix_rank(a) < k:
        raise ValueError("singular design")
    return dict(zip(xs, np.linalg.solve(a, b).tolist(), strict=True))


def fit(df: DataFrame, y: str, xs: Sequence[str], sample: str, group: str) -> dict[str, float]:
    """Weights, within-group centring and the normal equations; only the k x k moments reach the driver."""
    rows = centre(sample_weights(df, sample, group), [sample, group], [y, *xs], "weight")
    cs = [f"{x}_c" for x in xs]
    fitted = solve(moments(rows, f"{y}_c", cs, "weight").first(), cs)
    return {x: fitted[f"{x}_c"] for x in xs}


def predict(df: DataFrame, coefficients: dict[str, float], out: str = "prediction") -> DataFrame:
    """Linear score without intercepts."""
    score = F.lit(0.0)
    for x, b in coefficients.items():
        score = score + F.col(x) * F.lit(b)
    return df.withColumn(out, score)


def leave_one_group_out(df: DataFrame, y: str, xs: Sequence[str], sample: str, group: str, block: str) -> DataFrame:
    """Coefficients refitted with each block left out: (held_out, feature, coefficient).

    One pass sums products by (sample, group, block); a fold adds the sums of
    its blocks, centres them within each group and weighs them, as a weight is
    constant within a group. No row is copied.
    """
    blocks = [r[0] for r in df.select(block).distinct().orderBy(block).collect()]
    if len(blocks) > 1000:
        raise ValueError("leave-one-out over more than 1000 blocks")
    k = len(xs)
    cols = [*xs, y]
    pairs = [(i, j) for i in range(k) for j in range(i, k + 1)]
    sums = {f"s_{i}": F.sum(c) for i, c in enumerate(cols)} | {f"p_{i}_{j}": F.sum(F.col(cols[i]) * F.col(cols[j])) for i, j in pairs}
    cells = df.groupBy(sample, group, F.col(block).alias("_block")).agg(F.count(F.lit(1)).alias("_n"), *[c.cast("double").alias(n) for n, c in sums.items()])
    folds = cells.withColumn("held_out", F.explode(F.array(*[F.lit(b) for b in blocks]))).filter(F.col("held_out") != F.col("_block"))
    merged = folds.groupBy("held_out", sample, group).agg(F.sum("_n").alias("_n"), *[F.sum(n).alias(n) for n in sums])
    weight = 1.0 / (F.count(F.lit(1)).over(W.partitionBy("held_out", sample)) * F.col("_n"))
    centred = {f"p_{i}_{j}": F.col(f"p_{i}_{j}") - F.col(f"s_{i}") * F.col(f"s_{j}") / F.col("_n") for i, j in pairs}
    weighed = merged.select("held_out", weight.alias("_w"), *[c.alias(n) for n, c in centred.items()])
    names = {(i, j): f"xy_{i}" if j == k else f"xx_{i}_{j}" for i, j in pairs}
    out = []
    for row in weighed.groupBy("held_out").agg(*[F.sum(F.col("_w") * F.col(f"p_{i}_{j}")).alias(n) for (i, j), n in names.items()]).collect():
        out += [(row["held_out"], x, v) for x, v in solve(row, xs).items()]
    kind = dict(df.dtypes)[block]
    return df.sparkSession.createDataFrame(out, f"held_out {kind}, feature string, coefficient double")


def held_out_scores(df: DataFrame, cv: DataFrame, xs: Sequence[str], block: str, out: str = "score") -> DataFrame:
    """Every row scored by the fit that did not see its block; one row of coefficients a fold is broadcast."""
    wide = cv.groupBy(F.col("held_out").alias("_held")).agg(*[F.max(F.when(F.col("feature") == x, F.col("coefficient"))).alias(f"_b_{x}") for x in xs])
    score = F.lit(0.0)
    for x in xs:
        score = score + F.col(x) * F.col(f"_b_{x}")
    joined = df.join(F.broadcast(wide), F.col(block) == F.col("_held"))
    return joined.withColumn(out, score).drop("_held", *[f"_b_{x}" for x in xs])


def held_out_metrics(scored: DataFrame, keys: Sequence[str], score: str, amount: str, tie: str, fraction: float = 0.1) -> DataFrame:
    """(keys, n, n_represented, amount, rho, top_share, lift) over all held-out rows, zeros too: rank correlation, and what the best rows hold."""
    sizes = scored.groupBy(*keys).agg(F.count_if(F.col(amount) > 0).alias("n_represented"))
    rho = spearman(scored, keys, score, amount, "rho").select(*keys, "rho")
    top = top_share_and_lift(scored, list(keys), score, tie, amount, fraction).select(*keys, "n", "amount", "top_share", "lift")
    return top.join(sizes, list(keys)).join(rho, list(keys), "left")


def fold_summary(metrics: DataFrame, block: str, keys: Sequence[str] = ()) -> DataFrame:
    """Medians of the groups' metrics for every held-out block."""
    return metrics.groupBy(*keys, block).agg(F.sum("n").alias("n"), F.sum("n_represented").alias("n_represented"), F.sum("amount").alias("amount"), F.median("rho").alias("rho"), F.median("lift").alias("lift"))


def cross_summary(folds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Median, range and counts over the folds; undefined metrics are left out."""
    out = [F.count(F.lit(1)).alias("n_folds")]
    for m, above in (("rho", 0.0), ("lift", 1.0)):
        out += [F.median(m).alias(f"{m}_median"), F.min(m).alias(f"{m}_low"), F.max(m).alias(f"{m}_high"), F.count(m).alias(f"{m}_valid"), F.count_if(F.col(m) > above).alias(f"{m}_favourable")]
    return folds.groupBy(*keys).agg(*out)


def coefficient_stability(cv: DataFrame) -> DataFrame:
    """Median, range and sign agreement of each coefficient over the folds."""
    return cv.groupBy("feature").agg(
        F.median("coefficient").alias("median"), F.min("coefficient").alias("low"), F.max("coefficient").alias("high"),
        F.count(F.lit(1)).alias("n_folds"), ((F.count_if(F.col("coefficient") > 0) == 0) | (F.count_if(F.col("coefficient") <= 0) == 0)).alias("same_sign"),
    )

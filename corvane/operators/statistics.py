"""Correlations, exact tests and multiple-testing corrections as relational expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .order import beside, group_sizes, has_large_group, suffix_minimum
from .ranking import average_rank
from .scan import key_text

#: Differences up to which the binomial tail is folded from its first term, which does not underflow there.
FOLD_MOST = 1000


def guarded_corr(x: str, y: str, minimum: int = 2) -> Column:
    """Pearson correlation; NULL below ``minimum`` pairs or for a constant side."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.when(F.count_if(both) >= minimum, F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b))))


def pearson(df: DataFrame, keys: Sequence[str], x: str, y: str, out: str = "r", minimum: int = 2) -> DataFrame:
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    return df.groupBy(*keys).agg(guarded_corr(x, y, minimum).alias(out), F.count_if(both).alias("n"))


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, out: str = "rho", spread: bool | None = None) -> DataFrame:
    """Pearson correlation of average ranks over complete pairs."""
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_rank(average_rank(pairs, list(keys), x, "_rx", spread=spread), list(keys), y, "_ry", spread=spread)
    return pearson(ranked, keys, "_rx", "_ry", out)


def lag_correlation(df: DataFrame, keys: Sequence[str], bin_col: str, x: str, y: str, lags: Sequence[int], minimum: int = 10) -> DataFrame:
    """Correlation of x with y taken ``lag`` bins later, for every lag; series are dense and end where they end."""
    left = df.select(*keys, bin_col, F.col(x).alias("_x")).withColumn("lag", F.explode(F.array(*[F.lit(v) for v in lags]))).withColumn("_b", F.col(bin_col) + F.col("lag")).drop(bin_col)
    right = df.select(*keys, F.col(bin_col).alias("_b"), F.col(y).alias("_y"))
    return pearson(left.join(right, [*keys, "_b"]), [*keys, "lag"], "_x", "_y", "r", minimum)


def _stirling_error(x: Column) -> Column:
    """ln x! minus Stirling's formula, by its series (good to 1e-16 from 16 on)."""
    x2 = x * x
    return (F.lit(1 / 12) - (F.lit(1 / 360) - (F.lit(1 / 1260) - F.lit(1 / 1680) / x2) / x2) / x2) / x


def _log_half_binomial(n: Column, k: Column) -> Column:
    """ln of C(n, k) / 2^n for k <= n / 2, without the cancellation of log-factorials."""
    x, m = k.cast("double"), n.cast("double")
    d = 1 - 2 * x / m
    deviance = m / 2 * ((1 - d) * F.log1p(-d) + (1 + d) * F.log1p(d))
    saddle = _stirling_error(m) - _stirling_error(x) - _stirling_error(m - x) - deviance + 0.5 * F.log(m / (2 * F.lit(math.pi) * x * (m - x)))
    few = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(k, F.lit(16)), F.lit(1))), F.lit(0.0), lambda s, i: s + F.when(i <= k, F.log((m - i + 1) / i)).otherwise(0.0))
    return F.when(k < 16, few - m * F.lit(math.log(2))).otherwise(saddle)


def sign_test_p(positives: Column, negatives: Column) -> Column:
    """Exact two-sided sign test, zeros left out; NULL without a non-zero difference.

    Up to ``FOLD_MOST`` differences the binomial tail is folded upwards with the
    recurrence C(n,k) = C(n,k-1)(n-k+1)/k. Beyond, where 2^-n underflows, its last term is
    taken in logs and the terms before it downwards, as far as they reach 1e-16 of it (7 square roots of n).
    """
    n = (positives + negatives).cast("int")
    tail = F.least(positives, negatives).cast("int")
    start = F.struct(F.pow(F.lit(0.5), n).alias("t"), F.pow(F.lit(0.5), n).alias("s"))
    step = lambda acc, k: F.struct((acc["t"] * (n - k + 1) / k).alias("t"), (acc["s"] + acc["t"] * (n - k + 1) / k).alias("s"))
    none = F.array().cast("array<int>")
    up = F.when((tail > 0) & (n <= FOLD_MOST), F.sequence(F.lit(1), F.greatest(tail, F.lit(1)))).otherwise(none)
    one = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))
    down = lambda acc, j: F.struct((acc["t"] * (tail - j + 1) / (n - tail + j)).alias("t"), (acc["s"] + acc["t"] * (tail - j + 1) / (n - tail + j)).alias("s"))
    reach = F.least(tail, F.ceil(7 * F.sqrt(n)).cast("int") + 40)
    before = F.when((tail > 0) & (n > FOLD_MOST), F.sequence(F.lit(1), F.greatest(reach, F.lit(1)))).otherwise(none)
    large = F.exp(_log_half_binomial(n, tail)) * F.aggregate(before, one, down)["s"]
    # both halves overlap in the middle term when the signs balance
    return F.when(n > 0, F.least(F.lit(1.0), 2 * F.when(n <= FOLD_MOST, F.aggregate(up, start, step)["s"]).otherwise(large)))


def sign_test(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    agg = df.groupBy(*keys).agg(F.count_if(F.col(value) > 0).alias("n_positive"), F.count_if(F.col(value) < 0).alias("n_negative"))
    status = F.when(F.col("n_positive") + F.col("n_negative") > 0, F.lit("estimated")).otherwise(F.lit("no non-zero difference"))
    return agg.withColumn("p", sign_test_p(F.col("n_positive"), F.col("n_negative"))).withColumn("status", status)


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n; by Euler's series from 100 on, which is exact to 1e-15 there."""
    x = n.cast("double")
    series = F.log(x) + F.lit(0.5772156649015329) + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * F.pow(x, F.lit(4)))
    summed = F.aggregate(F.sequence(F.lit(1), F.least(F.greatest(n.cast("int"), F.lit(1)), F.lit(100))), F.lit(0.0), lambda acc, k: acc + F.lit(1.0) / k)
    return F.when(n < 100, summed).otherwise(series)


def adjust_p(df: DataFrame, family: Sequence[str], p: str, out: str, method: str = "BH", tie: Sequence[str] = (), spread: bool | None = None) -> DataFrame:
    """Step-up adjustment in a family (Benjamini-Hochberg, or Yekutieli with the harmonic factor); NULL p pass through.

    A family too large for one task is dealt by ranges of p (``operators.order``): equal p are one step.
    """
    factor = harmonic(F.col("_n")) if method == "BY" else F.lit(1.0)
    if has_large_group(df, family) if spread is None else spread:
        steps = df.filter(F.col(p).isNotNull()).groupBy(*family, p).agg(F.count(F.lit(1)).alias("_c"))
        sized = group_sizes(steps, family, F.sum("_c"), "_n")
        least = suffix_minimum(sized, family, p, F.col(p) * F.col("_n") * factor / F.col("_upto"), "_c", "_least")
        return beside(df, least, [*family, p]).withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), "_least"))).drop("_least")
    present = F.col(p).isNotNull()
    part = W.partitionBy(*family, present)
    n = F.count(F.lit(1)).over(part)
    ascending = F.row_number().over(part.orderBy(F.col(p), *tie))
    raw = df.withColumn("_n", n).withColumn("_i", ascending).withColumn("_raw", F.when(present, F.col(p) * F.col("_n") * factor / F.col("_i")))
    # the running minimum from the largest p down; equal p are one step by the RANGE frame
    down = W.partitionBy(*family, present).orderBy(F.col("_i").desc()).rowsBetween(W.unboundedPreceding, 0)
    return raw.withColumn(out, F.when(present, F.least(F.lit(1.0), F.min("_raw").over(down)))).drop("_n", "_i", "_raw")


def adjust_families(df: DataFrame, ids: Sequence[str], families: dict[str, tuple[Sequence[str], Column | None]], p: str, method: str = "BH") -> DataFrame:
    """Adds one adjusted column per family (name -> keys, condition) in one pass; a row outside a family's condition gets NULL.

    Every row stands once for each family it belongs to; all families are stepped up together, so one of them may
    hold all rows. ``ids`` tell rows apart.
    """
    member = lambda name, keys, inside: F.when(F.lit(True) if inside is None else inside, F.struct(F.lit(name).alias("name"), key_text(keys).alias("key")))
    members = F.filter(F.array(*[member(n, k, c) for n, (k, c) in families.items()]), lambda x: x.isNotNull())
    long = df.filter(F.col(p).isNotNull()).select(*ids, F.col(p).alias("_p"), F.explode(members).alias("_f"))
    stepped = adjust_p(long.select(*ids, "_p", F.col("_f.name").alias("_name"), F.col("_f.key").alias("_member")), ["_name", "_member"], "_p", "_q", method, ids)
    wide = stepped.groupBy(*ids).agg(*[F.max(F.when(F.col("_name") == n, F.col("_q"))).alias(n) for n in families])
    return beside(df, wide, ids)


def empirical_p(nulls: DataFrame, observed: DataFrame, keys: Sequence[str], value: str, obs: str) -> DataFrame:
    """((nulls >= observed) + 1) / (usable nulls + 1), missing nulls left out; NULL without an observation or a usable null."""
    usable = F.col(value).isNotNull() & ~F.isnan(value)
    joined = observed.join(nulls, list(keys), "left")
    agg = joined.groupBy(*keys, obs).agg(F.count_if(usable & (F.col(value) >= F.col(obs))).alias("n_exceed"), F.count_if(usable).alias("n_null"))
    return agg.withColumn("p", F.when(F.col(obs).isNotNull() & (F.col("n_null") > 0), (F.col("n_exceed") + 1) / (F.col("n_null") + 1)))


def null_medians(nulls: DataFrame, keys: Sequence[str], replicate: str, value: str, group: str | None = None) -> DataFrame:
    """(keys, replicate, value): the median of a replicate over rows, or over its groups' medians; missing values are left out."""
    usable = nulls.filter(F.col(value).isNotNull() & ~F.isnan(value))
    if group:
        usable = usable.groupBy(*keys, replicate, group).agg(F.median(value).alias(value))
    return usable.groupBy(*keys, replicate).agg(F.median(value).alias(value))


def null_results(observed: DataFrame, nulls: DataFrame, keys: Sequence[str], replicate: str, value: str, group: str | None = None, family: Sequence[str] = ()) -> DataFrame:
    """(keys, estimate, n_groups, n_rows, n_exceed, n_null, p, q): balanced estimate, its null replicates, and the family's step-up correction.

    Without ``group`` all rows weigh the same; with it a group's median counts
    once. Nulls balance as the estimate does, replicate by replicate.
    """
    usable = observed.filter(F.col(value).isNotNull() & ~F.isnan(value))
    sizes = usable.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), (F.count_distinct(group) if group else F.count(F.lit(1))).alias("n_groups"))
    balanced = usable.groupBy(*keys, group).agg(F.median(value).alias(value)) if group else usable
    estimate = balanced.groupBy(*keys).agg(F.median(value).alias("estimate")).join(sizes, list(keys))
    tested = empirical_p(null_medians(nulls, keys, replicate, value, group), estimate.select(*keys, "estimate"), keys, value, "estimate")
    return adjust_p(estimate.join(tested.drop("estimate"), list(keys)), family, "p", "q", tie=keys)


def lag_asymmetry(lags: DataFrame, keys: Sequence[str], lag: str = "lag", r: str = "r") -> DataFrame:
    """(keys, asymmetry): mean correlation at positive lags minus that at negative ones; NULL if a side has none."""
    side = lambda c: F.avg(F.when(c, F.col(r)))
    return lags.groupBy(*keys).agg((side(F.col(lag) > 0) - side(F.col(lag) < 0)).alias("asymmetry"))


def leave_one_out_median(df: DataFrame, group: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Median over the groups' medians with each group left out in turn."""
    medians = df.groupBy(*keys, group).agg(F.median(value).alias("_m"))
    omitted = medians.select(*keys, F.col(group).alias("omitted"))
    pairs = omitted.join(medians, list(keys)) if keys else omitted.crossJoin(medians)
    return pairs.filter(F.col("omitted") != F.col(group)).groupBy(*keys, "omitted").agg(F.median("_m").alias("estimate"), F.count("_m").alias("n_groups"))

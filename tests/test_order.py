"""Groups of any size: spread results equal those of one window, and known values."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import aggregates, order, ranking, statistics, windows


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, float("nan"), *[round(rng.gauss(0, 2), 1) for _ in range(9)]]), rng.choice([None, 0.0, 1.0, *[rng.random() ** 3 for _ in range(6)]]), i) for i in range(3000)]
    rows += [("only nulls", None, None, -1), ("one", 4.0, 0.2, -2)]
    return spark.createDataFrame(rows, "k string, v double, p double, id long").repartition(5)


def _same(a, b):
    plain = lambda df: sorted(((tuple(None if x is None else "nan" if isinstance(x, float) and math.isnan(x) else round(x, 9) if isinstance(x, float) else x for x in r)) for r in df.collect()), key=repr)
    assert a.columns == b.columns
    assert plain(a) == plain(b)


@pytest.mark.parametrize("keys", [["k"], []])
def test_spread_equals_window(values, keys):
    for call in (
        lambda s: ranking.competition_rank(values, keys, "v", "r", spread=s),
        lambda s: ranking.average_rank(values, keys, "v", "r", spread=s),
        lambda s: ranking.favourable_percentile(values, keys, "p", "r", True, spread=s),
        lambda s: ranking.top_fraction(values, keys, "v", "id", 0.1, spread=s),
        lambda s: statistics.adjust_p(values, keys, "p", "q", "BH", ["id"], spread=s),
        lambda s: statistics.adjust_p(values, keys, "p", "q", "BY", ["id"], spread=s),
        lambda s: aggregates.median_of(values, keys, {"v": "mv", "p": "mp"}, spread=s),
        lambda s: aggregates.percentile_of(values, keys, "v", 0.9, "x", spread=s),
    ):
        _same(call(True), call(False))
    _same(aggregates.balanced_median(values.withColumn("g", F.col("id") % 7), [[*keys, "g"], keys], "v", spread=True), aggregates.balanced_median(values.withColumn("g", F.col("id") % 7), [[*keys, "g"], keys], "v", spread=False))


def test_one_group_of_many_values_is_split(spark):
    n = 400_000
    df = spark.range(n).select(F.lit("x").alias("k"), ((F.col("id") * 7919) % n).cast("double").alias("v"))
    got = aggregates.median_of(df, ["k"], {"v": "m"}, spread=True)
    assert got.first()["m"] == (n - 1) / 2
    ranked = ranking.average_rank(df, ["k"], "v", "r", spread=True)
    assert ranked.filter(F.col("r") != F.col("v") + 1).count() == 0
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    # windows stand over (range partition, key), never over the key alone
    assert "_part" in plan and "hashpartitioning(k#" not in plan.split("Window")[-1]


def test_large_groups_are_found(spark):
    df = spark.range(100).withColumn("k", F.lit(1))
    assert not order.has_large_group(df, ["k"], 10)  # too small a relation to look
    big = spark.range(2_000_000).withColumn("k", F.col("id") % 2)
    assert order.has_large_group(big, ["k"], 900_000) and not order.has_large_group(big, ["k"])


def _exact(a, b):
    n, k = a + b, min(a, b)
    return float(min(Fraction(1), 2 * Fraction(sum(math.comb(n, i) for i in range(k + 1)), 2**n)))


def test_sign_test_of_any_size(spark):
    cases = [(0, 0), (3, 0), (5, 9), (540, 540), (500, 501), (1000, 1000), (1000, 1100), (20, 2000), (1400, 1650), (0, 1050), (7, 1000), (15, 1010), (16, 1010), (1990, 2400), (3000, 3001), (10_000, 10_300)]
    df = spark.createDataFrame(cases, "a long, b long").withColumn("p", statistics.sign_test_p(F.col("a"), F.col("b")))
    for r in df.collect():
        if r["a"] + r["b"] == 0:
            assert r["p"] is None
        else:
            want = _exact(r["a"], r["b"])
            assert math.isclose(r["p"], want, rel_tol=1e-10, abs_tol=1e-300), (r, want)


def test_harmonic_numbers(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 99, 100, 101, 5000)], "n long").withColumn("h", statistics.harmonic(F.col("n")))
    assert all(math.isclose(r["h"], float(np.sum(1 / np.arange(1, r["n"] + 1))), rel_tol=1e-13) for r in df.collect())


@pytest.mark.parametrize("width", [1, 2, 7, 40])
def test_sliding_means_of_a_series_in_blocks(values, width):
    """Frames that begin in one block and end in the next."""
    for keys in (["k"], []):
        call = lambda s, keys=keys: windows.sliding_mean(values, keys, "id", ["v", "p"], width, spread=s, block=40)
        _same(call(True), call(False))

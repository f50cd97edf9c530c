"""Shift nulls in blocks against rolling the whole series."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import shifts, statistics


def brute_force(series, anchors, key, width, replicates, exclusion, seed):
    n = len(series)
    out = []
    if n < 2 or not anchors:
        return out
    allowed = [s for s in range(1, n) if min(s, n - s) > exclusion] or list(range(1, n))
    up = [j for a in anchors for j in range(max(0, a - width), a)]
    down = [j for a in anchors for j in range(a + 1, min(n, a + 1 + width))]
    for r in range(replicates):
        s = allowed[int(hashlib.md5(f"{seed}|{key}|{r}".encode()).hexdigest()[:8], 16) % len(allowed)]
        x = np.roll(series, s)
        u, d = (x[w].sum() / len(w) if w else None for w in (up, down))
        out.append((key, r, s, None if u is None or d is None or u + d == 0 else (d - u) / (d + u)))
    return out


@pytest.mark.parametrize("block", [shifts.BLOCK, 7, 50])
def test_blocks_equal_rolling(spark, block):
    rng = random.Random(block)
    data = {"a": 200, "b": 31, "c": 2, "d": 1, "e": 90, "zeros": 40}
    rows, marks, want = [], [], []
    for k, n in data.items():
        values = [0.0 if k == "zeros" else rng.choice([0.0, 0.0, 1.0, 5.5]) for _ in range(n)]
        anchors = sorted(rng.sample(range(n), max(1, n // 9))) if k != "e" else []
        rows += [(k, 10 * i, v, 2 * v, "x") for i, v in enumerate(values)]
        marks += [(k, 10 * i) for i in anchors]
        want += brute_force(np.array(values), anchors, k, 6, 60, 20, 11)
    rng.shuffle(rows)
    track = spark.createDataFrame(rows, "k string, bin long, v double, w double, n string")
    got = shifts.shift_null(track, ["k"], "bin", ["v", "w"], spark.createDataFrame([*marks, marks[0], ("a", 5), ("absent", 0)], "k string, bin long"), 6, 60, 20, 11, block)
    assert got.columns == ["k", "replicate", "shift", "v", "w"]
    rows = sorted(map(tuple, got.collect()))
    assert [r[:3] for r in rows] == [r[:3] for r in sorted(want)]
    for r, w in zip(rows, sorted(want), strict=True):
        assert (r[3] is None) == (w[3] is None) and (w[3] is None or abs(r[3] - w[3]) < 1e-9 and abs(r[4] - w[3]) < 1e-9)


def test_null_of_an_empty_track(spark):
    track = spark.createDataFrame([], "k string, bin long, v double")
    assert shifts.shift_null(track, ["k"], "bin", ["v"], track.select("k", "bin"), 3, 5).count() == 0


def test_one_long_series(spark):
    """300,000 bins and 1,000 replicates in blocks of 8,192: no task holds the series."""
    n = 300_000
    track = spark.range(n).select(F.lit("x").alias("k"), F.col("id").alias("bin"), (F.pmod(F.xxhash64("id"), F.lit(7))).cast("double").alias("v"))
    anchors = track.filter(F.col("bin") % 997 == 5).select("k", "bin")
    got = shifts.shift_null(track, ["k"], "bin", ["v"], anchors, 50, 1000, 100, 3, block=8192)
    values = np.array([r["v"] for r in track.orderBy("bin").collect()])
    want = {w[1]: w[3] for w in brute_force(values, [r["bin"] for r in anchors.orderBy("bin").collect()], "x", 50, 20, 100, 3)}
    rows = got.collect()
    assert len(rows) == 1000 and all(abs(r["v"] - want[r["replicate"]]) < 1e-9 for r in rows if r["replicate"] in want)
    observed = spark.createDataFrame([("x", 0.5)], "k string, v double")
    tested = statistics.null_results(observed, got, ["k"], "replicate", "v").first()
    assert tested["n_null"] == 1000 and tested["n_exceed"] == 0 and tested["p"] == 1 / 1001

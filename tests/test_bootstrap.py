import random

import numpy as np
import pytest

from corvane.operators import bootstrap, resampling


def rows():
    r = random.Random(3)
    out = [(g, f"c{c:02d}", float(r.randrange(50))) for g, n in (("a", 7), ("b", 8), ("e", 1)) for c in range(n) for _ in range(r.randrange(1, 4))]
    return [*out, ("a", "c00", None), ("d", "c00", None), ("b", "zz", float("nan"))]


@pytest.mark.parametrize("rng", ["hash", "mt19937", "pcg64"])
def test_clustered_equals_the_collected_form(spark, rng):
    df = spark.createDataFrame(rows(), "g string, c string, v double").replace(float("nan"), None)
    key = lambda r: (r["g"], *[round(r[k], 9) for k in ("estimate", "ci_low", "ci_high", "n_clusters")])
    got = bootstrap.clustered_median_ci(df, ["g"], "c", "v", 60, 11, rng).collect()
    want = resampling.bootstrap_median_ci(df, ["g"], "c", "v", 60, 11, rng).collect()
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(got) == 3
    assert {r["replicates"] for r in got} == {60}


def test_clustered_without_rows_and_with_a_null_key(spark):
    df = spark.createDataFrame([(None, "x", 1.0), (None, None, 3.0)], "g string, c string, v double")
    r = bootstrap.clustered_median_ci(df, ["g"], "c", "v", 40).collect()
    assert len(r) == 1 and (r[0]["g"], r[0]["estimate"], r[0]["n_clusters"]) == (None, 2.0, 2)
    assert bootstrap.clustered_median_ci(df.limit(0), ["g"], "c", "v", 40).count() == 0
    whole = bootstrap.clustered_median_ci(df, [], "c", "v", 40).first()
    assert (whole["estimate"], whole["replicates"]) == (2.0, 40)
    with pytest.raises(Exception, match="unknown rng"):
        bootstrap.clustered_median_ci(df, ["g"], "c", "v", 40, rng="none").collect()


def test_draws_are_the_rows_of_the_index_matrix(spark):
    sizes = spark.createDataFrame([(5,), (5,), (0,), (9,)], "k int")
    for rng in ("hash", "mt19937", "pcg64"):
        got = {}
        for r in bootstrap.draw_table(sizes, "k", 6, 4, rng).collect():
            got[r["n"], r["replicate"], r["place"]] = r["times"]
        want = {}
        for n in (5, 9):
            for b, picks in enumerate(resampling.index_matrix(n, 6, 4, rng)):
                for p in picks:
                    want[n, b, int(p)] = want.get((n, b, int(p)), 0) + 1
        assert got == want


def test_middle_places_follow_the_law_of_drawn_medians():
    for n in (1, 2, 5, 8):
        values = np.arange(n, dtype=float)
        ours = [np.mean(values[list(bootstrap.median_places(n, s))]) for s in range(8000)]
        g = np.random.default_rng(1)
        theirs = np.median(values[g.integers(0, n, (8000, n))], axis=1)
        grid = np.unique(theirs)
        assert set(ours) <= set(grid)
        assert max(abs(np.mean(np.array(ours) <= x) - np.mean(theirs <= x)) for x in grid) < 0.03


def test_hierarchical_agrees_with_the_sequential_form(spark):
    r = np.random.default_rng(5)
    data = [(g, f"c{c}", float(x)) for g in "ab" for c in range(6) for x in r.normal(c, 2, 9 + c)] + [("b", "c0", None), ("z", "c", float("nan"))]
    df = spark.createDataFrame(data, "g string, c string, v double")
    got = {x["g"]: x for x in bootstrap.hierarchical_median_ci(df, ["g"], "c", "v", 800, 2).collect()}
    want = {x["g"]: x for x in resampling.hierarchical_bootstrap_ci(df.filter("g <> 'z'"), ["g"], "c", "v", 800, 2).collect()}
    assert set(got) == {"a", "b"}
    for g in got:
        assert (got[g]["replicates"], got[g]["n_clusters"]) == (800, 6)
        for k in ("ci_low", "ci_high"):
            assert abs(got[g][k] - want[g][k]) < 0.35
    again = {x["g"]: x for x in bootstrap.hierarchical_median_ci(df.repartition(5), ["g"], "c", "v", 800, 2).collect()}
    assert again == got
    assert bootstrap.hierarchical_median_ci(df.limit(0), ["g"], "c", "v", 10).count() == 0
    constant = spark.createDataFrame([("k", "c", 4.0)] * 3, "g string, c string, v double")
    one = bootstrap.hierarchical_median_ci(constant, ["g"], "c", "v", 10).first()
    assert (one["ci_low"], one["ci_high"], one["n_clusters"]) == (4.0, 4.0, 1)

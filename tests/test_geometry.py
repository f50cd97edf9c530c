"""Pairs of intervals that many reads share."""

import random

import pytest

from corvane.plans import geometry as G


@pytest.fixture(scope="module")
def reads(spark):
    rng = random.Random(5)
    places = [(rng.choice("ab"), rng.choice("xy"), rng.choice(["sense", "antisense"]), rng.choice("12"), rng.randint(0, 12), rng.randint(20, 24)) for _ in range(60)]
    rows = [(s, u, strand, c, i, i + n - 1, 1 + k % 3, 100 * j + k) for j, (s, u, strand, c, i, n) in enumerate(places) for k in range(rng.randint(1, 9))]
    return spark.createDataFrame(rows, "sample string, unit string, strand string, contig string, start long, end long, count long, id long")


def _rows(df):
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


def test_spectrum_by_places_equals_that_by_pairs(reads):
    got = G.paired_spectrum(reads, 3)
    assert _rows(got) == _rows(G.joint_spectrum(G.pairings(reads, 3)))


def test_reads_on_one_place_meet_once(spark):
    rows = [("a", "x", strand, "1", 5, 27, 1, i) for i, strand in enumerate(["sense"] * 300 + ["antisense"] * 200)]
    df = spark.createDataFrame(rows, "sample string, unit string, strand string, contig string, start long, end long, count long, id long")
    met = G.paired_places(df, 3).collect()
    assert [(r["d5"], r["d3"], r["n_focal"], r["n_passengers"]) for r in met] == [(0, 0, 300, 200)]
    assert [(r["n"], r["total"], r["fraction"]) for r in G.paired_spectrum(df, 3).collect()] == [(60000, 60000, 1.0)]


def test_farthest_equals_the_largest_distance_of_all_pairs(reads):
    pairs = G.pairings(reads, 4)
    want = pairs.groupBy("sample", "unit", "focal_id").max("d5").withColumnRenamed("max(d5)", "d5")
    assert _rows(G.farthest(reads, 4)) == _rows(want) and pairs.count() > want.count() > 0


def test_distances_count_all_pairs(reads):
    pairs = G.pairings(reads, 4)
    want = pairs.groupBy("sample", "unit", "focal_id", "d5", "d3").count().withColumnRenamed("count", "n")
    got = G.distances(reads, 4)
    assert _rows(got) == _rows(want) and got.count() < pairs.count()
    assert _rows(G.recovery(reads, got, (1, -1))) == _rows(G.recovery(reads, pairs, (1, -1)))

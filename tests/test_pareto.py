"""Fronts and dominance counts of strata of any size against brute force."""

import random

import pytest

from corvane.operators import pareto


def _dominates(a, b):
    return a != b and all(x >= y for x, y in zip(a, b, strict=True))


def fronts(points):
    left, out, n = set(points), {}, 1
    while left:
        front = {p for p in left if not any(_dominates(q, p) for q in left)}
        out |= dict.fromkeys(front, n)
        left, n = left - front, n + 1
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    out = [(rng.choice(["a", "b", None]), i, *[float(rng.randint(0, 9)) for _ in range(4)]) for i in range(420)]
    # a chain, whose fronts are as many as its points
    out += [("chain", 1000 + i, float(i), float(i), float(i // 2), 1.0) for i in range(60)]
    return [*out, ("a", 5000, None, 1.0, 1.0, 1.0), ("one", 5001, 1.0, 1.0, 1.0, 1.0)]


@pytest.mark.parametrize("n_values,most", [(3, 10**6), (3, 40), (4, 40), (2, 25), (1, 10**6)])
def test_fronts_equal_brute_force(spark, rows, n_values, most):
    values = ["x", "y", "z", "u"][:n_values]
    df = spark.createDataFrame(rows, "k string, id long, x double, y double, z double, u double")
    got = {r["id"]: r["front"] for r in pareto.pareto_fronts(df, ["k"], "id", values, task_rows=most).collect()}
    assert len(got) == len(rows) and got[5000] is None
    for k in {r[0] for r in rows}:
        mine = {r[1]: r[2 : 2 + n_values] for r in rows if r[0] == k and None not in r[2 : 2 + n_values]}
        want = fronts(mine.values())
        assert all(got[i] == want[v] for i, v in mine.items())


@pytest.mark.parametrize("most", [10**6, 30])
def test_dominance_counts_equal_brute_force(spark, rows, most):
    df = spark.createDataFrame(rows, "k string, id long, x double, y double, z double, u double")
    got = {r["id"]: r["n"] for r in pareto.dominance_count(df, ["k"], "id", ["x", "y", "z"], task_rows=most).collect()}
    for k in {r[0] for r in rows}:
        mine = {r[1]: r[2:5] for r in rows if r[0] == k and None not in r[2:5]}
        for i, v in mine.items():
            assert got.get(i, 0) == sum(_dominates(v, w) for w in mine.values())


def test_empty_table(spark):
    df = spark.createDataFrame([], "k string, id long, x double, y double, z double")
    assert pareto.pareto_fronts(df, ["k"], "id", ["x", "y", "z"]).count() == 0 and pareto.dominance_count(df, ["k"], "id", ["x", "y"]).count() == 0

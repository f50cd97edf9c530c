import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import nulls
from corvane.operators import quality, regression, resampling, statistics
from corvane.plans import letters
from corvane.sources import readers


def test_seed_takes_eight_bytes_of_the_joined_parts():
    want = (7 + int.from_bytes(hashlib.sha256(b"pair\x1fx\x1f250").digest()[:8], "big")) % (2**63 - 1)
    assert resampling.stable_seed(7, "pair", "x", 250) == want
    assert resampling.stable_seed(7, "a", "b") != resampling.stable_seed(7, "ab")


def test_empirical_p_needs_usable_nulls(spark):
    nulls_ = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None), ("b", float("nan"))], "k string, v double")
    seen = spark.createDataFrame([("a", 2.0), ("b", 2.0), ("c", 2.0), ("d", None)], "k string, obs double")
    got = {r["k"]: (r["p"], r["n_null"]) for r in statistics.empirical_p(nulls_, seen, ["k"], "v", "obs").collect()}
    assert got == {"a": (2 / 3, 2), "b": (None, 0), "c": (None, 0), "d": (None, 0)}


def test_null_results_balance_groups(spark):
    """Per replicate: medians of groups, then their median; missing values are left out."""
    rows = [("x", r, g, float(v)) for r in range(4) for g, vs in (("a", [r, r + 2, 9]), ("b", [r * 2]), ("c", [5])) for v in vs] + [("x", 0, "c", float("nan"))]
    null = spark.createDataFrame(rows, "k string, rep int, g string, v double")
    seen = spark.createDataFrame([("x", "a", 4.0), ("x", "a", 6.0), ("x", "b", 1.0), ("x", "c", None)], "k string, g string, v double")
    r = statistics.null_results(seen, null, ["k"], "rep", "v", "g").first()
    # replicate medians: 2, 3, 4, 5; the estimate is the median of 5 and 1
    assert (r["estimate"], r["n_groups"], r["n_rows"], r["n_exceed"], r["n_null"], r["p"], r["q"]) == (3.0, 2, 3, 3, 4, 0.8, 0.8)


def test_fasta_must_begin_with_a_header(spark, tmp_path):
    good, bad = tmp_path / "good.fa", tmp_path / "bad.fa"
    good.write_text("\n>one x\nac\ngt\n>two\nGG\n")
    bad.write_text("AC\nGT\n>one\nGG\n")
    got = [(r["id"], r["sequence"]) for r in readers.read_fasta(spark, str(good)).orderBy("id").collect()]
    assert got == [("one", "ACGT"), ("two", "GG")]
    with pytest.raises(ValueError, match="before the first"):
        readers.read_fasta(spark, str(bad))
    repeated = tmp_path / "twice.fa"
    repeated.write_text(">a\nAC\n>a\nGT\n")
    with pytest.raises(Exception, match="duplicate FASTA id"):
        readers.read_fasta(spark, str(repeated), unique=True).collect()


def test_end_corrections_must_be_there(spark, tmp_path):
    stacks = [f"stack\t{a}{b}\t-1.0" for a in "ACGU" for b in "ACGU"]
    head = "parameter_type\tparameter_id\tdelta_g37_kcal_mol"
    path = tmp_path / "p.tsv"
    path.write_text("\n".join([head, *stacks, "end_correction\tper_AU_end_on_AU\t0.22", "end_correction\tper_AU_end_on_GC\t0.44"]) + "\n")
    assert readers.read_stack_parameters(spark, str(path))[1] == {"AU": 0.22, "GC": 0.44}
    path.write_text("\n".join([head, *stacks, "end_correction\tper_AU_end_on_AU\t0.22"]) + "\n")
    with pytest.raises(ValueError, match="end corrections missing"):
        readers.read_stack_parameters(spark, str(path))


def test_distances_and_folds(spark, tmp_path):
    path = tmp_path / "d.tsv"
    path.write_text("\t".join(readers.DISTANCES) + "\nr\tf\tp\t-2\t0\t21\n")
    assert tuple(readers.read_distances(spark, str(path)).first()) == ("r", "f", "p", -2, 0, 21)
    path.write_text("\t".join(readers.DISTANCES) + "\nr\tf\tp\t-2\t0\t21\nr\tf\tp\t1\t0\t21\n")
    with pytest.raises(Exception, match="repeated distance"):
        readers.read_distances(spark, str(path)).collect()
    df = spark.createDataFrame([(1, "ACGU"), (2, None)], "id long, sequence string")
    got = {r["id"]: (r["structure"], r["energy"]) for r in readers.fold_targets(df, lambda s: ("." * len(s), -1.5)).collect()}
    assert got == {1: ("....", -1.5), 2: (None, None)}
    with pytest.raises(Exception, match="another length"):
        readers.fold_targets(df, lambda s: (".", 0.0)).collect()


def test_observed_letters_need_an_expectation(spark):
    obs = spark.createDataFrame([("s", "u", 23, "sense", "abundance", "5p1", "A", 1.0, 2)], "sample string, unit string, length int, strand string, mode string, position string, letter string, fraction double, total int")
    exp = spark.createDataFrame([("s", "u", 23, "sense", "5p1", "A", 0.5)], "sample string, unit string, length int, strand string, position string, letter string, expected double")
    assert letters.enrichment(obs, exp).first()["ratio"] == 2.0
    with pytest.raises(Exception, match="without an expectation"):
        letters.enrichment(obs, exp.filter("letter = 'C'")).collect()
    assert letters.enrichment(obs, exp.filter("letter = 'C'"), required=False).count() == 0


def test_exactly_one(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "k string, v int")
    assert quality.find_row(df, k="a", v=1)["v"] == 1
    for criteria in ({"k": "b"}, {"k": "z"}):
        with pytest.raises(ValueError, match="expected one row"):
            quality.find_row(df, **criteria)
    with pytest.raises(Exception, match="expected one row"):
        quality.exactly_one(df, ["k"]).collect()
    assert quality.exactly_one(df, ["k", "v"]).count() == 3
    assert quality.forbidden_features(["gc", "abundance_log", "abundance"], ["abundance"]) == ["abundance_log", "abundance"]
    assert set(quality.versions()) >= {"python", "pyspark"}


def test_six_digits_as_the_general_format(spark):
    rng = random.Random(3)
    values = [0.0, 1.0, -2.5, 1e-5, 123456.7, 1234567.0, 0.0001, 0.00009999999, 999999.5, 3e-12] + [rng.uniform(-1, 1) * 10 ** rng.randint(-8, 8) for _ in range(200)]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = df.select("v", nulls.six_digits("v").alias("t")).collect()
    wrong = [(r["v"], r["t"], f"{r['v']:.6g}") for r in got if r["t"] != f"{r['v']:.6g}"]
    assert not wrong
    # a half in decimal, below it in binary: rounds up here, down in the general format
    assert spark.range(1).select(nulls.six_digits(F.lit(99999.95)).alias("t")).first()["t"] == "100000"
    text = spark.range(1).select(nulls.support_text(F.lit(1.5), F.lit(-0.25), F.lit(0.0125)).alias("t"), nulls.support_text(F.lit(1.5), F.lit(None).cast("double"), F.lit(0.1)).alias("u")).first()
    assert tuple(text) == ("effect=1.5; delta=-0.25; corrected_p=0.0125", "not estimable")


def test_folds_equal_explicit_dummies(spark):
    """Coefficients with a block left out are those of weighted least squares with a dummy for every group."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(240):
        s, b = f"s{i % 4}", f"b{rng.integers(0, 3)}"
        rows.append((s, f"{b}{rng.integers(0, 2)}", b, float(rng.normal()), float(rng.normal()), 0.0, int(rng.integers(0, 4)), i))
    rows = [(s, g, b, x1, x2, 2 * x1 - x2 + len(s + g) + float(rng.normal()), a, i) for s, g, b, x1, x2, _, a, i in rows]
    df = spark.createDataFrame(rows, "sample string, unit string, block string, x1 double, x2 double, y double, abundance int, id int")
    got = {(r["held_out"], r["feature"]): r["coefficient"] for r in regression.leave_one_group_out(df, "y", ["x1", "x2"], "sample", "unit", "block").collect()}
    for held in ("b0", "b1", "b2"):
        part = [r for r in rows if r[2] != held]
        cells = sorted({r[:2] for r in part})
        groups = {s: sum(c[0] == s for c in cells) for s in {c[0] for c in cells}}
        n = {c: sum(r[:2] == c for r in part) for c in cells}
        w = np.sqrt([1 / (groups[r[0]] * n[r[:2]]) for r in part])
        design = np.array([[r[3], r[4], *(float(r[:2] == c) for c in cells)] for r in part])
        beta = np.linalg.lstsq(design * w[:, None], np.array([r[5] for r in part]) * w, rcond=None)[0]
        assert abs(got[held, "x1"] - beta[0]) < 1e-9 and abs(got[held, "x2"] - beta[1]) < 1e-9
    scored = regression.held_out_scores(df, regression.leave_one_group_out(df, "y", ["x1", "x2"], "sample", "unit", "block"), ["x1", "x2"], "block")
    r = scored.first()
    assert abs(r["score"] - got[r["block"], "x1"] * r["x1"] - got[r["block"], "x2"] * r["x2"]) < 1e-9
    metrics = regression.held_out_metrics(scored, ["block", "sample", "unit"], "score", "abundance", "id")
    assert metrics.agg(F.sum("n")).first()[0] == 240 and metrics.filter("lift is not null and lift < 0").count() == 0
    assert regression.cross_summary(regression.fold_summary(metrics, "block")).first()["n_folds"] == 3


def test_lag_asymmetry(spark):
    df = spark.createDataFrame([("a", -1, 0.25), ("a", 0, 9.0), ("a", 2, 0.75), ("a", 3, None), ("b", 1, 0.5)], "k string, lag int, r double")
    assert {r["k"]: r["asymmetry"] for r in statistics.lag_asymmetry(df, ["k"]).collect()} == {"a": 0.5, "b": None}

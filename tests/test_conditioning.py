import math

from corvane.plans import conditioning as K

RUN = ["sample", "length"]


def frame(spark, rows, spec):
    return spark.createDataFrame(rows, spec)


def runs(spark):
    focals = frame(spark, [("s", 23, "a", 4), ("s", 23, "b", 6), ("t", 23, "a", 1), ("u", 23, "c", 2)], "sample string, length int, focal_id string, count int")
    pairs = [("s", 23, "a", 21, 2, -2), ("s", 23, "a", 22, 0, 0), ("t", 23, "a", 21, 1, 1)]
    return focals, frame(spark, pairs, "sample string, length int, focal_id string, passenger_length int, d5 int, d3 int")


def declared(spark, lengths=(), numbers=(), spectrum=()):
    base = "sample string, length int"
    right_lengths = [("s", 23, 21, 1), ("s", 23, 22, 1), ("t", 23, 21, 1)]
    right_numbers = [("s", 23, "a", 2), ("s", 23, "b", 0), ("t", 23, "a", 1), ("u", 23, "c", 0)]
    right_spectrum = [("s", 23, "d5", 2, 1), ("s", 23, "d5", 0, 1), ("s", 23, "d5", 5, 0), ("s", 23, "d3", -2, 1), ("s", 23, "d3", 0, 1), ("t", 23, "d5", 1, 1), ("t", 23, "d3", 1, 1)]
    return (
        frame(spark, list(lengths or right_lengths), f"{base}, passenger_length int, n int"),
        frame(spark, list(numbers or right_numbers), f"{base}, focal_id string, n int"),
        frame(spark, list(spectrum or right_spectrum), f"{base}, end string, distance int, n int"),
    )


def faults(spark, **kw):
    focals, dup = runs(spark)
    return {r["scope"]: r["faults"] for r in K.reconcile_runs(focals, dup, *declared(spark, **kw), RUN).collect()}


def test_reconciled_runs(spark):
    assert faults(spark) == {"s:23": "", "t:23": "", "u:23": ""}
    # a length of the run that nobody declared, one declared as 0, one that is wrong
    assert faults(spark, lengths=[("s", 23, 21, 1), ("t", 23, 21, 2), ("u", 23, 30, 0)]) == {"s:23": "by_length=1", "t:23": "by_length=1", "u:23": "by_length=1"}
    # a focal read without a number, and a number without a focal read
    assert faults(spark, numbers=[("s", 23, "a", 2), ("t", 23, "a", 1), ("t", 23, "z", 0), ("u", 23, "c", 0)]) == {"s:23": "by_focal=1", "t:23": "by_focal=1", "u:23": ""}
    twice = [("s", 23, "d5", 2, 2), ("s", 23, "d3", -2, 1), ("s", 23, "d3", -2, 0), ("s", 23, "d3", 0, 1), ("t", 23, "d5", 1, 1), ("t", 23, "d3", 1, 1), ("t", 23, "d3", 9, 1)]
    assert faults(spark, spectrum=twice) == {"s:23": "end5=2; repeated=1", "t:23": "total3=1", "u:23": ""}


def test_pairs_of_unknown_focal_reads(spark):
    focals, dup = runs(spark)
    got = {r["scope"]: r["faults"] for r in K.reconcile_runs(focals.filter("sample <> 't'"), dup, *declared(spark), RUN).collect()}
    assert got["t:23"] == "unknown_focal=1"
    empty = [x.limit(0) for x in (focals, dup, *declared(spark))]
    assert K.reconcile_runs(*empty, RUN).count() == 0


def test_completed_runs(spark):
    focals, dup = runs(spark)
    dim = frame(spark, [("s", 23), ("t", 23), ("u", 23), ("w", 23)], "sample string, length int")
    pool = frame(spark, [("s",), ("s",), ("u",)], "sample string")
    got = {r["sample"]: r for r in K.complete_runs(dim, focals, pool, dup, RUN, ["sample"], (2, -2)).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"s": "recovered", "t": "zero_passenger_pool", "u": "zero_recovered", "w": "zero_focal"}
    s, w, u = got["s"], got["w"], got["u"]
    assert (s["n_focal"], s["n_recovered"], s["n_joint"], s["n_duplexes"], s["n_joint_duplexes"]) == (2, 1, 1, 2, 1)
    assert (s["recovered"], s["recovered_weighted"], s["joint_of_recovered"], s["joint_of_duplexes"]) == (0.5, 0.4, 1.0, 0.5)
    assert (w["n_focal"], w["recovered"], w["joint_of_duplexes"]) == (0, None, None)
    assert (u["recovered"], u["joint"], u["joint_of_recovered"]) == (0.0, 0.0, None)


CELL = "sample string, unit string, length int, strand string"


def test_conditioned_letters(spark):
    spec = f"{CELL}, id int, sequence string, count int"
    key = ("s", "u", 3, "sense")
    focals = frame(spark, [(*key, 1, "ACG", 3), (*key, 2, "CCG", 1), (*key, 3, "TTT", 5), ("t", "u", 3, "sense", 4, "AAA", 1), (*key, 5, "A", 9)], spec)
    ids = lambda *x: frame(spark, [(i,) for i in x], "id int")
    flagged = K.flag_focals(focals, ids(1, 2, 2), ids(1), ["id"])
    expected = frame(spark, [(*key, "5p1", "A", 0.5), (*key, "5p1", "C", 0.0)], f"{CELL}, position string, letter string, expected double")
    general = frame(spark, [(*key, "abundance", "5p1", "A", 1.0)], f"{CELL}, mode string, position string, letter string, ratio double")
    rows = K.conditioned_letters(flagged, expected, general)
    got = {(r["sample"], r["mode"], r["position"], r["letter"]): r for r in rows.collect()}
    assert len(got) == 2 * 2 * 4 * 4
    a = got["s", "abundance", "5p1", "A"]
    assert (a["n_focal"], a["n_recovered"], a["n_joint"], a["joint_total"], a["recovered_total"]) == (3, 2, 1, 3, 4)
    assert (a["joint_fraction"], a["recovered_fraction"], a["joint_ratio"], a["recovered_ratio"]) == (1.0, 0.75, 2.0, 1.5)
    assert a["joint_vs_general"] == 1.0 and math.isclose(a["joint_vs_recovered"], math.log2(2 / 1.5))
    c = got["s", "unique_sequence", "5p1", "C"]
    assert (c["joint_fraction"], c["recovered_fraction"], c["recovered_ratio"], c["has_expected"], c["has_general"]) == (0.0, 0.5, None, True, False)
    t = got["t", "abundance", "3p1", "A"]
    assert (t["n_focal"], t["n_joint"], t["joint_fraction"], t["joint_vs_general"]) == (1, 0, None, None)
    m = K.miss_counters(rows).first()
    # two expected letters serve both weightings
    assert m.asDict() == {"missing_expected": 60, "missing_general": 63, "empty_joint": 1, "empty_recovered": 1, "max_deviation": 0.0}
    summary = {(r["mode"], r["position"], r["letter"], r["metric"]): (r["value"], r["n_members"], r["n_undefined"]) for r in K.conditioned_summary(rows).collect()}
    assert summary["abundance", "5p1", "A", "joint_ratio"] == (2.0, 1, 1)
    assert K.miss_counters(rows.limit(0)).first().asDict() == {"missing_expected": 0, "missing_general": 0, "empty_joint": 0, "empty_recovered": 0, "max_deviation": 0.0}


def test_subsets_and_contrasts(spark):
    ids = lambda *x: frame(spark, [(i,) for i in x], "id int")
    row = K.subset_checks(ids(1, 1, 2, 3), ids(1, 1, 2, 7), ids(1, 3, 8), ["id"]).first()
    assert (row["status"], row["observed"], row["faults"]) == ("FAIL", 4, "unknown_recovered=1; unknown_joint=1; outside_recovered=2; repeated=1")
    rows = frame(spark, [("s", "u", 23, "x", 1.0), ("s", "u", 24, "x", 3.0), ("s", "v", 23, "x", 1.0), ("t", "u", 23, "x", 2.0), ("t", "u", 24, "x", 1.0)], f"{CELL}, m double")
    r = K.length_contrasts(rows, ["m"], 23, 24).first()
    assert (r["delta"], r["n_members"], r["n_undefined"]) == (0.5, 2, 0)

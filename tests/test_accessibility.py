from corvane.plans import candidates as C


def test_intervals_of_windows(spark):
    w = spark.createDataFrame([("t", "w1", 8, 10), ("t", "w2", 7, 9), ("u", "w1", 8, 10)], "target string, window_id string, length int, end int")
    band = [("t", "a", 10, 8, 0.5), ("t", "a", 9, 7, 0.25), ("t", "b", 10, 8, 0.75), ("t", "c", 10, 8, 0.1)]
    b = spark.createDataFrame(band, "target string, set string, end int, length int, p double")
    got = {(r["target"], r["window_id"]): (r["a_whole"], r["a_seed"], r["b_whole"], r["b_seed"]) for r in C.accessibility(w, b, ["a", "b"]).collect()}
    # a window of seven letters has no seed; target u has no band
    assert got == {("t", "w1"): (0.5, 0.25, 0.75, None), ("t", "w2"): (0.25, None, None, None), ("u", "w1"): (None, None, None, None)}
    assert C.accessibility(w.limit(0), b, ["a"]).count() == 0


def test_folds_of_short_targets(spark):
    w = spark.createDataFrame([("t", 5), ("u", 23), ("u", 24)], "target string, length int")
    t = spark.createDataFrame([("t", 20), ("u", 500), ("v", 9)], "target string, target_length int")
    got = {r["target"]: (r["interval"], r["effective_window"], r["effective_span"]) for r in C.fold_runs(w, t, [("a", 80, 40)]).collect()}
    assert got == {"t": (7, 20, 19), "u": (24, 80, 40)}

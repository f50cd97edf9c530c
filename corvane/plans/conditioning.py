"""Runs of paired reads: reconciled with what they declare, completed where empty, and letters conditioned on a geometry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import nulls as N
from ..functions import sequence as S
from ..operators import aggregates as A
from ..operators import joins as J
from ..session import Stored
from .letters import CELL, FEATURE, LETTERS, MODES
from .validation import fault_rows

#: What may disagree between a run's pairs and its declared tables.
RUN_FAULTS = ["unknown_focal", "by_length", "by_focal", "end5", "end3", "total5", "total3", "repeated"]


def reconcile_runs(focals: DataFrame, duplexes: DataFrame, lengths: DataFrame, numbers: DataFrame, spectrum: DataFrame, run: Sequence[str]) -> DataFrame:
    """One ledger row for each run: whether the counts of its pairs are those its tables declare.

    ``focals``: run, focal_id. ``duplexes``: run, focal_id, passenger_length, d5, d3. Declared are pairs by passenger length
    (``lengths``: run, passenger_length, n), by focal read, 0 included (``numbers``: run, focal_id, n), and by distance of an
    end (``spectrum``: run, end 'd5' or 'd3', distance, n). Lengths and numbers must agree on every key, distances wherever
    pairs were counted and in their total. Pairs are counted once, by all keys together; both counts meet in one
    grouping, a full outer comparison without a join. Keys of a run that are declared twice are ``repeated``. NULL keys
    count as the key "".
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    entry = lambda what, key: F.struct(F.lit(what).alias("_what"), text(key).alias("_key"))
    entries = F.array(entry("length", "passenger_length"), entry("number", "focal_id"), entry("d5", "d5"), entry("d3", "d3"))
    counted = duplexes.select(*run, F.inline(entries)).groupBy(*run, "_what", "_key").agg(F.count(F.lit(1)).alias("_n"))
    known = focals.select(*run, F.lit("number").alias("_what"), text("focal_id").alias("_key")).distinct().withColumn("_n", F.lit(0))
    declared = lengths.select(*run, F.lit("length").alias("_what"), text("passenger_length").alias("_key"), "n")
    declared = declared.unionByName(numbers.select(*run, F.lit("number").alias("_what"), text("focal_id").alias("_key"), "n"))
    declared = declared.unionByName(spectrum.select(*run, F.col("end").alias("_what"), text("distance").alias("_key"), "n"))
    none = F.lit(None).cast("long")
    sides = counted.select("*", none.alias("_d"), F.lit(False).alias("_focal")).unionByName(known.select("*", none.alias("_d"), F.lit(True).alias("_focal")))
    sides = sides.unionByName(declared.select(*run, "_what", "_key", none.alias("_n"), F.col("n").cast("long").alias("_d"), F.lit(False).alias("_focal")))
    keys = sides.groupBy(*run, "_what", "_key").agg(F.sum("_n").alias("_n"), F.sum("_d").alias("_d"), F.count("_d").alias("_times"), F.max("_focal").alias("_focal"))
    what, differ = F.col("_what"), ~F.col("_n").eqNullSafe(F.col("_d"))
    seen = F.col("_n").isNotNull() & (F.coalesce("_d", F.lit(0)) != F.col("_n"))
    count = lambda w, c: F.count_if((what == w) & c)
    total = lambda w: (F.coalesce(F.sum(F.when(what == w, F.col("_d"))), F.lit(0)) != F.coalesce(F.sum(F.when(what == w, F.col("_n"))), F.lit(0))).cast("int")
    per_run = keys.groupBy(*run).agg(
        F.sum(F.when(what == "d5", F.col("_n"))).alias("n"), count("number", (F.col("_n") > 0) & ~F.col("_focal")).alias("unknown_focal"), count("length", differ).alias("by_length"),
        count("number", differ).alias("by_focal"), count("d5", seen).alias("end5"), count("d3", seen).alias("end3"), total("d5").alias("total5"), total("d3").alias("total3"),
        F.count_if(F.col("_times") > 1).alias("repeated"),
    )
    return fault_rows(per_run, "run", F.concat_ws(":", *[F.col(k).cast("string") for k in run]), F.col("n"), RUN_FAULTS)


def complete_runs(runs: DataFrame, focals: DataFrame, passengers: DataFrame, duplexes: DataFrame, run: Sequence[str], pool: Sequence[str], geometry: tuple[int, int]) -> DataFrame:
    """Recovery of every run of the dimension ``runs``, empty ones included, with why it is empty.

    ``focals``: run, focal_id, count. ``passengers``: ``pool`` (some of the run's keys), one row a read. ``duplexes``: run, focal_id, d5, d3.
    Status is zero_focal, zero_passenger_pool, zero_recovered or recovered. Counts of an empty run are 0, shares
    of an empty whole NULL. A focal read counts once, however many partners it has.
    """
    hits = duplexes.groupBy(*run, "focal_id").agg(F.count(F.lit(1)).alias("_pairs"), F.count_if((F.col("d5") == geometry[0]) & (F.col("d3") == geometry[1])).alias("_joint"))
    found, joint = F.col("_pairs").isNotNull(), F.coalesce(F.col("_joint") > 0, F.lit(False))
    amounts = {
        "n_focal": F.count(F.lit(1)), "n_recovered": F.count_if(found), "n_joint": F.count_if(joint), "n_duplexes": F.sum("_pairs"), "n_joint_duplexes": F.sum("_joint"),
        "abundance": F.sum("count"), "abundance_recovered": F.sum(F.when(found, F.col("count"))), "abundance_joint": F.sum(F.when(joint, F.col("count"))),
    }
    per_run = focals.join(hits, [*run, "focal_id"], "left").groupBy(*run).agg(*[c.alias(k) for k, c in amounts.items()])
    pools = passengers.groupBy(*pool).agg(F.count(F.lit(1)).alias("n_passengers"))
    full = runs.select(*run).distinct().join(per_run, list(run), "left").join(pools, list(pool), "left")
    full = full.withColumns({k: F.coalesce(k, F.lit(0)) for k in [*amounts, "n_passengers"]})
    status = F.when(F.col("n_focal") == 0, "zero_focal").when(F.col("n_passengers") == 0, "zero_passenger_pool").when(F.col("n_recovered") == 0, "zero_recovered").otherwise("recovered")
    return full.withColumns({
        "status": status, "recovered": N.safe_ratio("n_recovered", "n_focal"), "recovered_weighted": N.safe_ratio("abundance_recovered", "abundance"),
        "joint": N.safe_ratio("n_joint", "n_focal"), "joint_weighted": N.safe_ratio("abundance_joint", "abundance"),
        "joint_of_recovered": N.safe_ratio("n_joint", "n_recovered"), "joint_of_recovered_weighted": N.safe_ratio("abundance_joint", "abundance_recovered"),
        "joint_of_duplexes": N.safe_ratio("n_joint_duplexes", "n_duplexes"),
    })


def flag_focals(focals: DataFrame, recovered: DataFrame, joint: DataFrame, key: Sequence[str]) -> DataFrame:
    """Focal reads with ``is_recovered`` and ``is_joint``, by semi-join keys that may repeat."""
    mark = lambda df, name: df.select(*key, F.lit(True).alias(name)).distinct()
    out = focals.join(mark(recovered, "is_recovered"), list(key), "left").join(mark(joint, "is_joint"), list(key), "left")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("is_recovered", "is_joint")})


def subset_checks(focals: DataFrame, recovered: DataFrame, joint: DataFrame, key: Sequence[str]) -> DataFrame:
    """One ledger row: subset reads that are no focal reads, joint ones outside the recovered, and repeated focal reads."""
    sides = [df.select(*key, *[F.lit(int(i == j)).alias(n) for j, n in enumerate(["_f", "_r", "_j"])]) for i, df in enumerate([focals, recovered, joint])]
    keys = sides[0].unionByName(sides[1]).unionByName(sides[2]).groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("_f", "_r", "_j")])
    f, r, j = (F.col(c) > 0 for c in ("_f", "_r", "_j"))
    agg = keys.agg(
        F.sum("_f").alias("n"), F.count_if(r & ~f).alias("unknown_recovered"), F.count_if(j & ~f).alias("unknown_joint"),
        F.count_if(j & ~r).alias("outside_recovered"), F.count_if(F.col("_f") > 1).alias("repeated"),
    )
    return fault_rows(agg, "subsets", F.lit("all"), F.col("n"), ["unknown_recovered", "unknown_joint", "outside_recovered", "repeated"])


CONDITIONED = ["joint_fraction", "recovered_fraction", "joint_ratio", "recovered_ratio", "joint_vs_general", "joint_vs_recovered"]


def conditioned_letters(focals: DataFrame, expected: DataFrame, general: DataFrame) -> DataFrame:
    """Terminal letters of the joint and the recovered reads of each run, on the full grid, against expectation and all reads.

    ``focals``: sample, unit, length, strand, sequence, count, is_recovered, is_joint; one row a distinct read. ``expected``:
    cell, position, letter, expected. ``general``: cell, mode, position, letter, ratio. Every run of the focal reads gets
    every weighting, position and letter; shares of an empty subset are NULL, and so are ratios and contrasts without
    a positive partner. ``has_expected`` and ``has_general`` tell a missing partner from a NULL one. Reads below
    two letters are left out.
    """
    ends, flags = S.terminal_letters("sequence"), ["is_recovered", "is_joint"]
    reads = focals.filter(F.length("sequence") >= 2).groupBy(*CELL, *flags, *[c.alias(f"_{k}") for k, c in ends.items()])
    # a few rows for each run, stored: what follows reads them many times, and the focal reads once
    reads = Stored(reads.agg(F.sum("count").alias("count"), F.count(F.lit(1)).alias("_reads")), "conditioned").df
    subsets = {"recovered": F.col("is_recovered"), "joint": F.col("is_joint")}
    weight = {"abundance": F.col("count"), "unique_sequence": F.col("_reads")}
    sums = {f"_{s}_{m}": F.sum(F.when(c, w).otherwise(0)) for s, c in subsets.items() for m, w in weight.items()}
    totals = reads.groupBy(*CELL).agg(F.sum("_reads").alias("n_focal"), *[F.sum(F.when(c, F.col("_reads")).otherwise(0)).alias(f"n_{s}") for s, c in subsets.items()], *[v.alias(f"{k}_total") for k, v in sums.items()])
    items = [F.struct(F.lit(k).alias("position"), F.col(f"_{k}").alias("letter")) for k in ends]
    letters = reads.filter("is_recovered or is_joint").select(*CELL, "count", "_reads", *flags, F.inline(F.array(*items)))
    counts = letters.groupBy(*CELL, "position", "letter").agg(*[v.alias(k) for k, v in sums.items()])
    grid = J.parameter_grid(J.parameter_grid(totals, "position", list(S.TERMINALS)), "letter", LETTERS)
    wide = grid.join(counts, [*CELL, "position", "letter"], "left")
    per_mode = F.array(*[
        F.struct(F.lit(m).alias("mode"), *[x for s in subsets for x in (F.coalesce(f"_{s}_{m}", F.lit(0)).alias(f"{s}_n"), F.col(f"_{s}_{m}_total").alias(f"{s}_total"))]) for m in MODES
    ])
    long = wide.select(*CELL, "position", "letter", "n_focal", "n_recovered", "n_joint", F.inline(per_mode))
    e = expected.select(*CELL, "position", "letter", "expected", F.lit(True).alias("has_expected"))
    g = general.select(*CELL, "mode", "position", "letter", F.col("ratio").alias("general_ratio"), F.lit(True).alias("has_general"))
    out = long.join(e, [*CELL, "position", "letter"], "left").join(g, [*CELL, "mode", "position", "letter"], "left")
    out = out.withColumns({f"{s}_fraction": N.safe_ratio(f"{s}_n", f"{s}_total") for s in subsets} | {c: F.coalesce(c, F.lit(False)) for c in ("has_expected", "has_general")})
    out = out.withColumns({f"{s}_ratio": F.when(F.col("expected") > 0, F.col(f"{s}_fraction") / F.col("expected")) for s in subsets})
    return out.withColumns({"joint_vs_general": N.safe_log2_ratio("joint_ratio", "general_ratio"), "joint_vs_recovered": N.safe_log2_ratio("joint_ratio", "recovered_ratio")}).drop("joint_n", "recovered_n")


def conditioned_summary(rows: DataFrame) -> DataFrame:
    """Balanced medians of the conditioned metrics over units, then samples."""
    keys = [*FEATURE, "metric"]
    long = rows.select(*FEATURE, "sample", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in CONDITIONED])))
    return A.balanced_median(long, [[*keys, "sample"], keys], "value")


def miss_counters(rows: DataFrame) -> DataFrame:
    """One row: cells without an expectation or a general ratio, runs with an empty subset, and the worst deviation of shares from 1."""
    shares = rows.groupBy(*CELL, "mode", "position").agg(
        F.count_if(~F.col("has_expected")).alias("_e"), F.count_if(~F.col("has_general")).alias("_g"), F.max(F.col("n_joint") == 0).alias("_j"), F.max(F.col("n_recovered") == 0).alias("_r"),
        F.greatest(F.abs(F.sum("joint_fraction") - 1), F.abs(F.sum("recovered_fraction") - 1)).alias("_d"),
    )
    runs = shares.groupBy(*CELL).agg(F.sum("_e").alias("_e"), F.sum("_g").alias("_g"), F.max("_j").alias("_j"), F.max("_r").alias("_r"), F.max("_d").alias("_d"))
    return runs.agg(
        F.coalesce(F.sum("_e"), F.lit(0)).alias("missing_expected"), F.coalesce(F.sum("_g"), F.lit(0)).alias("missing_general"), F.count_if("_j").alias("empty_joint"),
        F.count_if("_r").alias("empty_recovered"), F.coalesce(F.max("_d"), F.lit(0.0)).alias("max_deviation"),
    )


def length_contrasts(rows: DataFrame, metrics: Sequence[str], low: int, high: int, length: str = "length", keys: Sequence[str] = ("strand",)) -> DataFrame:
    """Balanced median difference of each metric between two lengths of the same pair; NULL where a side is missing."""
    long = rows.select("sample", "unit", length, *keys, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), N.finite(m).alias("value")) for m in metrics])))
    delta = J.paired_difference(long, ["sample", "unit", *keys, "metric"], length, low, high, "value")
    return A.balanced_median(delta, [[*keys, "metric", "sample"], [*keys, "metric"]], "delta")

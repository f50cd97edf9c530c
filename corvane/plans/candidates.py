"""Candidate windows of registered targets: enumeration, annotation, biophysics, layers, ranks and regions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import nulls as N
from ..functions import sequence as S
from ..operators import joins as J
from ..operators import pareto as P
from ..operators import ranking as R
from ..operators import statistics as T
from ..operators import windows as X
from ..operators.order import has_large_group
from ..session import Stored


def enumerate_windows(targets: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """All windows of each target for each length: id, coordinates, DNA, RNA and guide."""
    sized = J.parameter_grid(targets, "length", [int(v) for v in lengths])
    w = S.explode_windows(sized, "sequence", F.col("length"), "start", "dna").withColumn("end", F.col("start") + F.col("length") - 1)
    rna = F.translate("dna", "T", "U")
    return w.select(
        "target", S.window_identifier("target", "length", "start", "end").alias("window_id"), "length", "start", "end",
        "dna", rna.alias("rna"), S.revcomp(rna, rna=True).alias("guide"),
    )


def annotate(windows: DataFrame, intervals: DataFrame, last: int, width: int = 64) -> DataFrame:
    """Start label, all labels crossed, and whether a boundary is crossed."""
    covered = J.with_gaps(intervals, "istart", "iend", "label", last)
    crossed = J.crossed_labels(windows, "window_id", covered, "start", "end", "istart", "iend", "label", (), width)
    at_start = J.range_join(windows, intervals, "start", "istart", "iend", "label", (), "unannotated", width).withColumnRenamed("label", "start_label")
    return at_start.join(crossed, "window_id")


def stability(windows: DataFrame, ks: Sequence[int] = (4, 5)) -> DataFrame:
    """Stack energies of both ends and their asymmetry (guide minus passenger)."""
    out = windows
    for k in ks:
        out = out.withColumns({f"guide_dg{k}": S.stack_energy("guide", k), f"passenger_dg{k}": S.stack_energy("rna", k)})
        out = out.withColumn(f"asymmetry{k}", F.col(f"guide_dg{k}") - F.col(f"passenger_dg{k}"))
    return out


def layer_scores(df: DataFrame, strata: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Favourable percentile of every metric within its stratum; the rows and the result are stored once for all that read them."""
    out = Stored(df, "layers").df
    spread = has_large_group(out, strata)
    for m in metrics:
        out = R.favourable_percentile(out, list(strata), m, f"{m}_pct", spread=spread)
    return Stored(out, "layer-scores").df


def weight_grid(df: DataFrame, a: str, b: str, steps: int = 10) -> DataFrame:
    """alpha * a + (1 - alpha) * b for alpha = 0, 1/steps, ..., 1."""
    g = J.parameter_grid(df, "step", list(range(steps + 1))).withColumn("alpha", F.col("step") / F.lit(float(steps)))
    return g.withColumn("score", F.col("alpha") * F.col(a) + (1 - F.col("alpha")) * F.col(b))


def integrate(df: DataFrame, strata: Sequence[str], key: str, layers: Sequence[str]) -> DataFrame:
    """Equal-weight score, descending average rank, percentile, weakest layer and Pareto front."""
    a, b, c = layers
    out = df.withColumn("score", (F.col(a) + F.col(b) + F.col(c)) / F.lit(3.0)).withColumn("weakest", F.least(*layers))
    out = R.average_rank(out, list(strata), "score", "rank", descending=True)
    out = R.favourable_percentile(out, list(strata), "score", "percentile")
    return P.pareto_fronts(out, strata, key, layers)


def layer_agreement(df: DataFrame, strata: Sequence[str], layers: Sequence[str]) -> DataFrame:
    """Spearman correlation of every pair of layers; whether a stratum is large is asked once, as complete pairs are no more than its rows."""
    out, spread = None, has_large_group(df, strata)
    for i, a in enumerate(layers):
        for b in layers[i + 1 :]:
            rho = T.spearman(df, strata, a, b, spread=spread).withColumn("layer_a", F.lit(a)).withColumn("layer_b", F.lit(b))
            out = rho if out is None else out.unionByName(rho)
    return out


def regions(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], window: int, region: int) -> DataFrame:
    """Mean of the windows that a region holds, for every region start; none if the region is shorter than a window."""
    width = region - window + 1
    if width < 1:
        return X.sliding_mean(df, keys, order, values, 1).limit(0)
    return X.sliding_mean(df, keys, order, values, width)


def training_universe(background: DataFrame, observed: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """Distinct reverse-complemented windows of each pair with their observed abundance and whether represented."""
    sized = J.parameter_grid(background, "length", [int(v) for v in lengths])
    w = S.explode_windows(sized, "sequence", F.col("length")).filter(S.is_plain("window"))
    opp = w.select("sample", "unit", "length", S.revcomp("window").alias("sequence")).distinct()
    return J.opportunity_match(opp, observed, ["sample", "unit", "length", "sequence"], "count")


def accessibility(windows: DataFrame, bands: DataFrame, sets: Sequence[str], seed_first: int = 7, seed_last: int = 1) -> DataFrame:
    """The windows with ``<set>_whole`` and ``<set>_seed`` for every parameter set: probability that all of an interval is unpaired.

    ``bands``: target, set, end, length, p. The seed reaches from ``seed_first`` letters before a window's end to
    ``seed_last`` before it; windows that do not hold it wholly behind their first letter, and intervals that
    the band lacks, get NULL. All intervals of all sets meet the bands in one join.
    """
    whole = F.struct(F.lit("whole").alias("_part"), F.col("end").cast("int").alias("_end"), F.col("length").cast("int").alias("_len"))
    seed = F.struct(F.lit("seed").alias("_part"), (F.col("end") - seed_last).cast("int").alias("_end"), F.lit(seed_first - seed_last + 1).alias("_len"))
    parts = F.when(F.col("length") > seed_first, F.array(whole, seed)).otherwise(F.array(whole))
    asked = windows.select("target", "window_id", F.inline(parts))
    table = bands.filter(F.col("set").isin(*sets)).select("target", "set", F.col("end").cast("int").alias("_end"), F.col("length").cast("int").alias("_len"), "p")
    cell = lambda s, part: F.max(F.when((F.col("set") == s) & (F.col("_part") == part), F.col("p"))).alias(f"{s}_{part}")
    found = asked.join(table, ["target", "_end", "_len"], "left").groupBy("target", "window_id").agg(*[cell(s, part) for s in sets for part in ("whole", "seed")])
    return windows.join(found, ["target", "window_id"], "left")


def fold_runs(windows: DataFrame, targets: DataFrame, parameters: Sequence[tuple[str, int, int]]) -> DataFrame:
    """The folds that ``accessibility`` needs, one for each target with windows and parameter set (name, window, span).

    ``targets``: target, target_length. ``interval`` is the longest interval asked for, 7 at least. A target
    shorter than the window is folded whole, with pairs up to one letter less.
    """
    longest = windows.groupBy("target").agg(F.greatest(F.max("length").cast("long"), F.lit(7)).alias("interval"))
    sets = F.array(*[F.struct(F.lit(n).alias("set"), F.lit(w).alias("window"), F.lit(k).alias("span")) for n, w, k in parameters])
    runs = longest.join(targets.select("target", "target_length"), "target").select("target", "interval", "target_length", F.inline(sets))
    width, span = N.clamp_window("window", "span", "target_length")
    return runs.withColumns({"effective_window": width, "effective_span": span}).drop("target_length")

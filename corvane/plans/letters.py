"""Observed against expected letters, by terminal and by position; features, evidence classes and corrections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nulls as N
from ..functions import sequence as S
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import resampling as B
from ..operators import statistics as T
from ..session import Stored

PAIR = ["sample", "unit"]
LETTERS = ["A", "C", "G", "T"]
MODES = ["abundance", "unique_sequence"]
CELL = [*PAIR, "length", "strand"]


def usable(reads: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """Reads of the wanted lengths whose sequence is plain and as long as declared."""
    return reads.filter(F.col("length").isin(*lengths) & S.is_plain("sequence") & (F.length("sequence") == F.col("length")))


def _letters(df: DataFrame, seq: str, terminal: bool) -> DataFrame:
    """(position, letter) rows; a terminal's position is its name."""
    if not terminal:
        return S.explode_letters(df, seq)
    items = [F.struct(F.lit(k).alias("position"), v.alias("letter")) for k, v in S.terminal_letters(seq).items()]
    return df.filter(F.length(seq) >= 2).select("*", F.inline(F.array(*items)))


def observed(reads: DataFrame, terminal: bool = True) -> DataFrame:
    """Letter weights per pair, length, strand and position: summed counts, and distinct sequences each once.

    Sequences collapse before they are taken apart, so a letter row stands for
    a distinct sequence and not for a read. The counts, a few for each cell, are
    stored: what follows reads them many times, and the reads once.
    """
    distinct = reads.groupBy(*CELL, "sequence").agg(F.sum("count").alias("count"))
    counts = _letters(distinct, "sequence", terminal).groupBy(*CELL, "position", "letter").agg(
        F.sum("count").alias("abundance"), F.count(F.lit(1)).alias("unique_sequence")
    )
    return Stored(counts, "letters").df


def dense_letters(counts: DataFrame, positions: Sequence, keys: Sequence[str]) -> DataFrame:
    """Absent letters as 0, both weightings as rows, share within each position."""
    grid = A.dense_grid(counts, counts.select(*keys).distinct(), {"position": positions, "letter": LETTERS}, dict.fromkeys(MODES, 0))
    long = grid.unpivot([*keys, "position", "letter"], MODES, "mode", "n")
    return A.share_of_total(long, [*keys, "mode", "position"], "n", "fraction", "total")


def with_combined(counts: DataFrame) -> DataFrame:
    """Strands, and both summed as the strand "combined"."""
    both = counts.groupBy(*PAIR, "length", "position", "letter").agg(*[F.sum(m).alias(m) for m in MODES]).withColumn("strand", F.lit("combined"))
    return counts.unionByName(both)


def background_windows(background: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """All windows of every record for each length; ``valid`` is false where a letter is masked."""
    sized = J.parameter_grid(background, "length", [int(v) for v in lengths])
    return S.explode_windows(sized, "sequence", F.col("length")).withColumn("valid", S.is_plain("window"))


def expected(background: DataFrame, lengths: Sequence[int], terminal: bool = True, positions: Sequence | None = None) -> DataFrame:
    """Letter shares of the valid windows; the antisense strand reads their reverse complements. The counts are stored, as those observed."""
    valid = background_windows(background, lengths).filter("valid").select(*PAIR, "length", "window")
    stranded = J.parameter_grid(valid, "strand", ["sense", "antisense"]).withColumn("window", S.oriented("window", "strand"))
    counts = Stored(_letters(stranded, "window", terminal).groupBy(*CELL, "position", "letter").agg(F.count(F.lit(1)).alias("n")), "expected").df
    pos = positions or (list(S.TERMINALS) if terminal else list(range(1, max(lengths) + 1)))
    grid = A.dense_grid(counts, counts.select(*CELL).distinct(), {"position": pos, "letter": LETTERS}, {"n": 0})
    return A.share_of_total(grid, [*CELL, "position"], "n", "expected", "windows").filter(F.col("windows") > 0)


def combined_expectation(obs: DataFrame, exp: DataFrame) -> DataFrame:
    """Expected shares of both strands together, weighted by each weighting's observed strand totals."""
    totals = obs.filter(F.col("strand") != "combined").groupBy(*PAIR, "length", "mode", "position").agg(
        F.max(F.when(F.col("strand") == "sense", F.col("total"))).alias("_s"), F.max(F.when(F.col("strand") == "antisense", F.col("total"))).alias("_a")
    )
    s, a = F.coalesce("_s", F.lit(0)), F.coalesce("_a", F.lit(0))
    shares = totals.withColumn("sense_share", N.safe_ratio(s, s + a)).withColumn("antisense_share", N.safe_ratio(a, s + a))
    wide = exp.groupBy(*PAIR, "length", "position", "letter").agg(
        F.max(F.when(F.col("strand") == "sense", F.col("expected"))).alias("_es"), F.max(F.when(F.col("strand") == "antisense", F.col("expected"))).alias("_ea")
    )
    joined = shares.join(wide, [*PAIR, "length", "position"])
    mixed = joined.withColumn("expected", N.mixed_expectation("sense_share", "_es", "antisense_share", "_ea"))
    return mixed.select(*PAIR, "length", "mode", "position", "letter", "sense_share", "antisense_share", "expected")


def enrichment(obs: DataFrame, exp: DataFrame, combined: DataFrame | None = None, required: bool = True) -> DataFrame:
    """Observed over expected share on the full key; an observed row without an expectation raises, or is left out if none is ``required``."""
    keys = [*CELL, "position", "letter"]
    if dict(obs.dtypes)["position"] != "string":  # a grid of positions goes on behind the shorter lengths
        obs = obs.filter(F.col("position") <= F.col("length"))
    single = obs.filter(F.col("strand") != "combined").join(exp.select(*keys, "expected", F.lit(True).alias("_found")), keys, "left")
    if combined is not None:
        by = [*PAIR, "length", "mode", "position", "letter"]
        both = obs.filter(F.col("strand") == "combined").join(combined.select(*by, "expected", F.lit(True).alias("_found")), by, "left")
        single = single.unionByName(both)
    if not required:
        return single.filter("_found").drop("_found").withColumn("ratio", N.enrichment("fraction", "expected", "total"))
    missing = F.raise_error(F.lit("observed letters without an expectation")).cast("double")
    single = single.withColumn("expected", F.when(F.col("_found"), F.col("expected")).otherwise(missing)).drop("_found")
    return single.withColumn("ratio", N.enrichment("fraction", "expected", "total"))


FEATURE = ["length", "strand", "mode", "position", "letter"]


def enrichment_samples(e: DataFrame) -> DataFrame:
    return e.filter(F.col("ratio").isNotNull()).groupBy(*FEATURE, "sample").agg(F.median("ratio").alias("ratio"), F.count("ratio").alias("n_units"))


def enrichment_dataset(e: DataFrame) -> DataFrame:
    return A.balanced_median(e.filter(F.col("ratio").isNotNull()), [[*FEATURE, "sample"], FEATURE], "ratio").drop("n_undefined")


def enrichment_pooled(e: DataFrame) -> DataFrame:
    return A.pooled_ratio(e.filter(F.col("mode") == "abundance"), ["length", "strand", "position", "letter"], "n", "expected", "total")


def length_agreement(dataset: DataFrame, low: int, high: int) -> DataFrame:
    """Spearman correlation of the two lengths' feature vectors."""
    pairs = J.across_values(Stored(dataset, "lengths").df, ["strand", "mode", "position", "letter"], "length", low, high, ["ratio"])
    return T.spearman(pairs, ["strand", "mode"], "ratio_low", "ratio_high")


def positional(obs: DataFrame, exp: DataFrame, required: bool = True) -> DataFrame:
    """Abundance against unique enrichment at every position: one row per feature with both and their ratio."""
    e = enrichment(obs, exp, required=required)
    keys = [*CELL, "position", "letter"]
    pick = lambda m, c: F.max(F.when(F.col("mode") == m, F.col(c)))
    wide = e.groupBy(*keys).agg(
        F.max("expected").alias("expected"), pick("abundance", "fraction").alias("abundance_fraction"), pick("unique_sequence", "fraction").alias("unique_fraction"),
        pick("abundance", "ratio").alias("abundance_ratio"), pick("unique_sequence", "ratio").alias("unique_ratio"),
    )
    acc = N.accumulation("abundance_ratio", "unique_ratio")
    return wide.withColumns({"accumulation_ratio": acc["ratio"], "accumulation_delta": acc["delta"], "accumulation_log2": acc["log2_ratio"]})


def discovery(pos: DataFrame, value: str) -> DataFrame:
    """Sample medians, sign test and both corrections; families are the inner positions of (length, strand)."""
    samples = pos.groupBy("length", "strand", "position", "letter", "sample").agg(F.median(value).alias("_m"))
    tested = T.sign_test(samples, ["length", "strand", "position", "letter"], "_m")
    inner = F.col("position").between(3, F.col("length") - 2)
    marked = tested.withColumn("inner", inner).withColumn("p_family", F.when(inner, F.col("p")))
    tie = ["position", "letter"]
    return T.adjust_p(T.adjust_p(marked, ["length", "strand"], "p_family", "q_bh", "BH", tie), ["length", "strand"], "p_family", "q_by", "BY", tie)


#: Metrics of the positional aggregate; the inferred difference and the effect with its interval follow the mode.
POSITION_METRICS = ["observed", "expected", "enrichment", "delta", "unique_fraction", "abundance_fraction", "accumulation_ratio", "accumulation_delta", "accumulation_log2"]
POSITION_KEYS = ["length", "strand", "mode", "position", "letter"]


def position_modes(pos: DataFrame) -> DataFrame:
    """A row of ``positional`` as three: both representations against the expectation, and their accumulation, with nine metrics."""
    none = F.lit(None).cast("double")

    def row(mode: str, values: dict[str, Column]) -> Column:
        return F.struct(F.lit(mode).alias("mode"), *[values.get(m, none).alias(m) for m in POSITION_METRICS])

    def representation(mode: str, short: str) -> Column:
        share = F.col(f"{short}_fraction")
        return row(mode, {"observed": share, "expected": F.col("expected"), "enrichment": F.col(f"{short}_ratio"), "delta": share - F.col("expected")})

    accumulation = row("accumulation", {m: F.col(m) for m in POSITION_METRICS[4:]})
    rows = F.explode(F.array(representation("abundance", "abundance"), representation("unique_sequence", "unique"), accumulation)).alias("_r")
    return pos.select(*CELL, "position", "letter", rows).select(*CELL, "position", "letter", "_r.*")


def positional_aggregate(pos: DataFrame, replicates: int, level: float = 0.95) -> DataFrame:
    """Nine sample-balanced medians of every feature and mode, the clustered interval of its effect, its sign test and both corrections.

    A sample counts if its inferred difference is defined. Families are the inner
    positions of (length, mode, strand). An effect without a sample has no interval, a
    feature without a non-zero difference no p.
    """
    samples = position_modes(pos).groupBy(*POSITION_KEYS, "sample").agg(*[F.median(N.finite(m)).alias(m) for m in POSITION_METRICS])
    mode = F.col("mode") == "accumulation"
    samples = samples.withColumn("_d", F.when(mode, F.col("accumulation_delta")).otherwise(F.col("delta"))).withColumn("_e", F.when(mode, F.col("accumulation_ratio")).otherwise(F.col("enrichment")))
    samples = samples.filter(F.col("_d").isNotNull())
    summary = samples.groupBy(*POSITION_KEYS).agg(
        F.count(F.lit(1)).alias("n_samples_total"), *[F.median(m).alias(m) for m in POSITION_METRICS], F.count("_e").alias("n_samples"),
        F.count_if(F.col("_d") > 0).alias("n_positive"), F.count_if(F.col("_d") < 0).alias("n_negative"),
    )
    interval = B.bootstrap_median_ci_sql(samples, POSITION_KEYS, "_e", "sample", replicates, level)
    p = T.sign_test_p(F.col("n_positive"), F.col("n_negative"))
    tested = summary.join(interval, POSITION_KEYS, "left").withColumn("p", p).withColumn("estimable", F.col("n_positive") + F.col("n_negative") > 0)
    inner = F.when(F.col("position").between(3, F.col("length") - 2), F.col("p"))
    family, tie = ["length", "mode", "strand"], ["position", "letter"]
    marked = tested.withColumn("_p", inner)
    return T.adjust_p(T.adjust_p(marked, family, "_p", "q_bh", "BH", tie), family, "_p", "q_by", "BY", tie).drop("_p")


def gc_windows(obs: DataFrame, width: int) -> DataFrame:
    """Mean share of G and C over ``width`` neighbouring positions; NULL if a member is missing."""
    gc = obs.filter(F.col("letter").isin("G", "C")).groupBy(*CELL, "mode", "position").agg(F.sum("fraction").alias("gc"))
    from ..operators.windows import sliding_mean

    return sliding_mean(gc, [*CELL, "mode"], "position", ["gc"], width)


def regional_windows(df: DataFrame, width: int) -> DataFrame:
    """Labels of windows that begin at ``position``: both ends from the 5' and from the 3' end."""
    end = F.col("position") + width - 1
    near, far = F.col("length") - end + 1, F.col("length") - F.col("position") + 1
    return df.withColumns({"end_5p": end, "near_3p": near, "far_3p": far, "region_5p": F.concat(F.lit("GC"), "position", F.lit("-"), end), "region_3p": F.concat(F.lit("GC_3p"), near, F.lit("-"), far)})


def regional(obs: DataFrame, exp: DataFrame, width: int) -> DataFrame:
    """Mean share of G and C of every window inside its length, observed by both weightings and expected, with three deltas and labels."""
    seen = gc_windows(obs, width).filter(F.col("position") + width - 1 <= F.col("length"))
    wide = seen.groupBy(*CELL, "position").agg(*[F.max(F.when(F.col("mode") == m, F.col("gc_mean"))).alias(m) for m in MODES])
    expectation = gc_windows(exp.withColumn("mode", F.lit("expected")).withColumn("fraction", F.col("expected")), width).select(*CELL, "position", F.col("gc_mean").alias("expected"))
    deltas = N.regional_deltas("unique_sequence", "abundance", "expected")
    return regional_windows(wide.join(expectation, [*CELL, "position"], "left").withColumns(deltas), width)


def regional_discovery(regions: DataFrame, value: str) -> DataFrame:
    """Sample medians, their median over samples, the sign test and the corrections over all windows of a (length, strand)."""
    keys = ["length", "strand", "position"]
    samples = regions.groupBy(*keys, "sample").agg(F.median(value).alias("_m"))
    tested = T.sign_test(samples, keys, "_m").join(samples.groupBy(*keys).agg(F.median("_m").alias("estimate"), F.count("_m").alias("n_samples")), keys)
    return T.adjust_p(T.adjust_p(tested, ["length", "strand"], "p", "q_bh", "BH", ["position"]), ["length", "strand"], "p", "q_by", "BY", ["position"])


def grouped_letters(obs: DataFrame, groups: dict[int, tuple[str, str]]) -> DataFrame:
    """Summed share of two letters at given positions."""
    cond = None
    for p, (a, b) in groups.items():
        c = (F.col("position") == p) & F.col("letter").isin(a, b)
        cond = c if cond is None else cond | c
    return obs.filter(cond).groupBy(*CELL, "mode", "position").agg(F.sum("fraction").alias("share"), F.concat_ws("", F.array_sort(F.collect_set("letter"))).alias("letters"))


def evidence_class(corrected: Column, same_sign: Column, cross_length: Column) -> Column:
    """HIGH, SUPPORTIVE, CONTEXT_ONLY or NOT_DEFAULT from three findings."""
    return (
        F.when(corrected & same_sign & cross_length, "HIGH")
        .when(corrected & same_sign, "SUPPORTIVE")
        .when(corrected | cross_length, "CONTEXT_ONLY")
        .otherwise("NOT_DEFAULT")
    )


def cross_length(found: DataFrame, low: int, high: int, from_3p: bool) -> DataFrame:
    """Features of both lengths at the same distance from one end: same sign, and corrected in both."""
    coord = F.col("length") - F.col("position") + 1 if from_3p else F.col("position")
    inner = found.filter("inner").withColumn("coordinate", coord)
    both = J.across_values(inner, ["strand", "letter", "coordinate"], "length", low, high, ["n_positive", "n_negative", "q_by"])
    sign = lambda t: F.signum(F.col(f"n_positive_{t}") - F.col(f"n_negative_{t}"))
    return both.withColumn("same_sign", sign("low") == sign("high")).withColumn(
        "corrected_in_both", F.coalesce((F.col("q_by_low") < 0.05) & (F.col("q_by_high") < 0.05), F.lit(False))
    )


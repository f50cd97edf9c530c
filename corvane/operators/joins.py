"""Joins. Range joins become equi joins on buckets, so no plan needs a nested loop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: A side is broadcast only when its counted rows stay below this.
BROADCAST_ROWS = 100_000


def if_small(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint after counting at most ``bound`` + 1 rows; beyond the bound the planner chooses."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def primary_rows(df: DataFrame, eligible: DataFrame, keys: Sequence[str], extra: Column | None = None) -> DataFrame:
    """Rows of eligible keys that pass an extra predicate; the predicate reaches the scan."""
    rows = df if extra is None else df.filter(extra)
    return rows.join(eligible.select(*keys).distinct(), list(keys), "left_semi")


def opportunity_match(opportunities: DataFrame, observed: DataFrame, keys: Sequence[str], amount: str) -> DataFrame:
    """Every opportunity with its observed amount, 0 if none, and whether it is represented."""
    joined = opportunities.join(observed.groupBy(*keys).agg(F.sum(amount).alias(amount)), list(keys), "left")
    return joined.withColumn(amount, F.coalesce(amount, F.lit(0))).withColumn("represented", (F.col(amount) > 0).cast("long"))


def supported(observed: DataFrame, opportunities: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Observed rows that have an opportunity."""
    return observed.join(opportunities.select(*keys), list(keys), "left_semi")


def unsupported(observed: DataFrame, opportunities: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Observed rows without an opportunity."""
    return observed.join(opportunities.select(*keys), list(keys), "left_anti")


def paired_difference(df: DataFrame, keys: Sequence[str], by: str, low, high, value: str, out: str = "delta") -> DataFrame:
    """value(high) - value(low) by key in one aggregation; NULL if either side is missing."""
    pick = lambda v: F.max(F.when(F.col(by) == v, F.col(value)))
    return df.groupBy(*keys).agg(pick(low).alias("value_low"), pick(high).alias("value_high")).withColumn(out, F.col("value_high") - F.col("value_low"))


def across_values(df: DataFrame, keys: Sequence[str], by: str, low, high, values: Sequence[str]) -> DataFrame:
    """Rows of one value beside the rows of another with equal keys; both must exist."""
    side = lambda v, tag: df.filter(F.col(by) == v).select(*keys, *[F.col(c).alias(f"{c}_{tag}") for c in values])
    return side(low, "low").join(side(high, "high"), list(keys), "inner")


def one_to_one(frames: Sequence[DataFrame], key: str, same: Sequence[str]) -> DataFrame:
    """Joins relations that must hold the same unique keys and agree on the columns ``same``; a breach raises at run time."""
    counted = [f.groupBy(key).agg(F.count(F.lit(1)).alias(f"_n{i}"), *[F.first(c).alias(c if i == 0 else f"_{i}_{c}") for c in f.columns if c != key]) for i, f in enumerate(frames)]
    out = counted[0]
    for other in counted[1:]:
        out = out.join(other, key, "full")
    bad = F.lit(False)
    for i in range(len(frames)):
        bad = bad | F.coalesce(F.col(f"_n{i}") != 1, F.lit(True))
        if i:
            for c in same:
                bad = bad | ~F.col(c).eqNullSafe(F.col(f"_{i}_{c}"))
    checked = out.withColumn(key, F.when(~bad, F.col(key)).otherwise(F.raise_error(F.lit("relations are not one to one")).cast(dict(out.dtypes)[key])))
    keep = [F.col(key), *[F.col(c) for c in frames[0].columns if c != key]]
    for i, f in enumerate(frames[1:], 1):
        keep += [F.col(f"_{i}_{c}").alias(c) for c in f.columns if c != key and c not in same]
    return checked.select(*keep)


def _bucketed(intervals: DataFrame, start: str, end: str, width: int) -> DataFrame:
    return intervals.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))


def range_join(points: DataFrame, intervals: DataFrame, position: str, start: str, end: str, label: str, on: Sequence[str] = (), default: str | None = None, width: int = 64) -> DataFrame:
    """Each point with the label of the first interval (by start, then label) that holds it, else ``default``.

    Intervals are cut into buckets of ``width`` positions and joined on the
    bucket, so the work follows the points. A hot bucket is left to adaptive
    skew handling: the join needs no aggregation above it, because
    overlapping intervals are resolved on the interval side.
    """
    cut = _bucketed(intervals, start, end, width).select(*on, "_b", F.struct(start, end, label).alias("_i"))
    lookup = cut.groupBy(*on, "_b").agg(F.array_sort(F.collect_list("_i")).alias("_list"))
    found = points.withColumn("_b", F.floor(F.col(position) / width)).join(lookup, [*on, "_b"], "left")
    hits = F.filter("_list", lambda i: (F.col(position) >= i[start]) & (F.col(position) <= i[end]))
    return found.withColumn(label, F.coalesce(F.get(hits, F.lit(0))[label], F.lit(default))).drop("_b", "_list")


def with_gaps(intervals: DataFrame, start: str, end: str, label: str, last: int, on: Sequence[str] = (), default: str = "unannotated") -> DataFrame:
    """Intervals completed to cover 1..last, gaps carrying the default label."""
    w = W.partitionBy(*on).orderBy(start)
    before = F.coalesce(F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    marked = intervals.select(*on, start, end, label).withColumn("_prev", before)
    gaps = marked.filter(F.col(start) > F.col("_prev") + 1).select(*on, (F.col("_prev") + 1).cast("int").alias(start), (F.col(start) - 1).cast("int").alias(end), F.lit(default).alias(label))
    tail = intervals.groupBy(*on).agg(F.max(end).alias("_e")).filter(F.col("_e") < last).select(*on, (F.col("_e") + 1).cast("int").alias(start), F.lit(last).cast("int").alias(end), F.lit(default).alias(label))
    return marked.select(*on, F.col(start).cast("int"), F.col(end).cast("int"), label).unionByName(gaps).unionByName(tail)


def crossed_labels(windows: DataFrame, key: str, covered: DataFrame, win_start: str, win_end: str, start: str, end: str, label: str, on: Sequence[str] = (), width: int = 64) -> DataFrame:
    """Labels that each window crosses, in order, neighbours of equal label joined; ``covered`` has no gaps."""
    left = windows.withColumn("_b", F.explode(F.sequence(F.floor(F.col(win_start) / width), F.floor(F.col(win_end) / width))))
    hit = left.join(_bucketed(covered, start, end, width), [*on, "_b"]).filter((F.col(start) <= F.col(win_end)) & (F.col(end) >= F.col(win_start)))
    agg = hit.groupBy(*on, key).agg(F.array_sort(F.collect_set(F.struct(start, label))).alias("_l"))
    names = F.transform("_l", lambda i: i[label])
    runs = F.filter(names, lambda v, i: (i == 0) | (v != F.get(names, i - 1)))
    return agg.select(*on, key, F.array_join(runs, ";").alias("labels"), (F.size(runs) > 1).alias("crosses_boundary"))


def band_lookup(df: DataFrame, table: DataFrame, start: Column, end: Column, out: str, on: Sequence[str] = ()) -> DataFrame:
    """Value stored under (end, length) for the interval [start, end]."""
    keyed = df.withColumn("_end", end.cast("int")).withColumn("_len", (end - start + 1).cast("int"))
    side = table.select(*on, F.col("end").alias("_end"), F.col("length").alias("_len"), F.col("p").alias(out))
    return keyed.join(side, [*on, "_end", "_len"], "left").drop("_end", "_len")


def window_means(track: DataFrame, anchors: DataFrame, keys: Sequence[str], bin_col: str, value: str, width: int) -> DataFrame:
    """Pooled mean of the bins before and after the anchors (anchor bin excluded, overlaps counted again).

    ``track`` is dense, so windows that leave it are cut by the join.
    """
    offsets = F.explode(F.array(*[F.lit(o) for o in range(-width, width + 1) if o]))
    wanted = anchors.select(*keys, bin_col, offsets.alias("_o")).withColumn(bin_col, (F.col(bin_col) + F.col("_o")).cast("long"))
    side = F.when(F.col("_o") < 0, "up").otherwise("down")
    hit = wanted.join(track.withColumn(bin_col, F.col(bin_col).cast("long")), [*keys, bin_col])
    return hit.groupBy(*keys, side.alias("side")).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n")).withColumn("mean", F.try_divide(F.col("total").cast("double"), F.col("n")))


def opposite_pairs(df: DataFrame, keys: Sequence[str], strand: str, left: str, right: str, ids: Sequence[str]) -> DataFrame:
    """Rows of one strand beside rows of the other within the same keys."""
    a = df.filter(F.col(strand) == left).select(*keys, *[F.col(c).alias(f"focal_{c}") for c in ids])
    b = df.filter(F.col(strand) == right).select(*keys, *[F.col(c).alias(f"passenger_{c}") for c in ids])
    return a.join(b, list(keys))


def parameter_grid(df: DataFrame, name: str, values: Sequence) -> DataFrame:
    """Every row once for each literal value."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))

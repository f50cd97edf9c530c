"""Fractional tracks, anchors, flanking means and their endpoints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.nulls import directionality, safe_ratio
from ..operators import joins as J


def fractional_loci(loci: DataFrame, reads: DataFrame) -> DataFrame:
    """Weight of every locus: a read's count, or 1 for a distinct sequence, split evenly over its distinct loci.

    ``loci`` has read_name, contig and start; ``reads`` adds unit, strand,
    length, sequence and count. Reads of one sequence pool their loci.
    """
    named = loci.dropDuplicates(["read_name", "contig", "start"]).join(reads, "read_name")
    n = F.count(F.lit(1)).over(W.partitionBy("read_name"))
    abundance = named.withColumn("weight", F.col("count") / n).withColumn("mode", F.lit("abundance"))
    keys = ["unit", "strand", "length", "sequence"]
    pooled = named.select(*keys, "contig", "start").distinct()
    unique = pooled.withColumn("weight", F.lit(1.0) / F.count(F.lit(1)).over(W.partitionBy(*keys))).withColumn("mode", F.lit("unique_sequence"))
    cols = [*keys, "contig", "start", "mode", "weight"]
    return abundance.select(*cols).unionByName(unique.select(*cols))


def binned(points: DataFrame, keys: Sequence[str], position: str, kind: str, value: str, width: int, kinds: Sequence[str]) -> DataFrame:
    """One row per key and bin, one column per kind, sums of the value."""
    b = points.withColumn("bin", F.floor(F.col(position) / width).cast("long"))
    return b.groupBy(*keys, "bin").agg(*[F.coalesce(F.sum(F.when(F.col(kind) == k, F.col(value))), F.lit(0.0)).alias(k) for k in kinds])


def dense_track(track: DataFrame, keys: Sequence[str], n_bins: int, kinds: Sequence[str]) -> DataFrame:
    """All bins 0..n_bins-1 of every key, absent ones 0."""
    grid = track.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_bins - 1).cast("long"))))
    return grid.join(track, [*keys, "bin"], "left").fillna(0.0, list(kinds))


def flank_means(track: DataFrame, anchors: DataFrame, keys: Sequence[str], kinds: Sequence[str], width: int) -> DataFrame:
    """Means before and after the anchors, one column per kind and side."""
    offsets = F.explode(F.array(*[F.lit(o) for o in range(-width, width + 1) if o]))
    wanted = anchors.select(*keys, F.col("bin").alias("_a"), offsets.alias("_o")).select(*keys, (F.col("_a") + F.col("_o")).cast("long").alias("bin"), (F.col("_o") > 0).alias("_down"))
    hit = wanted.join(track, [*keys, "bin"])
    side = lambda k, down: F.avg(F.when(F.col("_down") == down, F.col(k)))
    return hit.groupBy(*keys).agg(*[side(k, d).alias(f"{k}_{'down' if d else 'up'}") for k in kinds for d in (False, True)])


def endpoints(means: DataFrame, target: str, control: str, other: str) -> DataFrame:
    """Directionality of target and control, their difference, and the change of the target's share against another track."""
    d_t, d_c = directionality(f"{target}_down", f"{target}_up"), directionality(f"{control}_down", f"{control}_up")
    f_down = safe_ratio(F.col(f"{target}_down"), F.col(f"{other}_down") + F.col(f"{target}_down"))
    f_up = safe_ratio(F.col(f"{target}_up"), F.col(f"{other}_up") + F.col(f"{target}_up"))
    return means.withColumns({"d_target": d_t, "d_control": d_c, "specific": d_t - d_c, "share_down": f_down, "share_up": f_up, "share_delta": f_down - f_up})


__all__ = ["J", "binned", "dense_track", "endpoints", "flank_means", "fractional_loci"]

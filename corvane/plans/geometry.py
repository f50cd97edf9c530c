"""Opposite-strand geometry: pairing, recovery, joint distance spectra and conditioned contrasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import safe_log2_ratio, safe_ratio
from ..operators import aggregates as A
from ..operators import joins as J
from ..session import Stored

PAIR = ["sample", "unit"]


def pairings(rows: DataFrame, max_distance: int) -> DataFrame:
    """Focal (sense) and passenger (antisense) intervals of a pair on the same bucketed contig, with end distances.

    d5 and d3 are signed distances of the ends; a pairing stands if both lie
    within ``max_distance``. The join is on the pair, the contig and the start's
    bucket or its neighbours, never on the pair alone.
    """
    width = max(1, max_distance)
    focal = rows.filter(F.col("strand") == "sense").select(*PAIR, "contig", F.col("id").alias("focal_id"), F.col("start").alias("_fs"), F.col("end").alias("_fe"), F.col("count").alias("focal_count"))
    focal = focal.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_fs") / width) - 1, F.floor(F.col("_fs") / width) + 1)))
    other = rows.filter(F.col("strand") == "antisense").select(*PAIR, "contig", F.col("id").alias("passenger_id"), F.col("start").alias("_ps"), F.col("end").alias("_pe"), F.floor(F.col("start") / width).alias("_b"))
    hit = focal.join(other, [*PAIR, "contig", "_b"])
    out = hit.withColumn("d5", (F.col("_ps") - F.col("_fs")).cast("long")).withColumn("d3", (F.col("_pe") - F.col("_fe")).cast("long"))
    return out.filter((F.abs("d5") <= max_distance) & (F.abs("d3") <= max_distance)).select(*PAIR, "focal_id", "passenger_id", "focal_count", "d5", "d3")


def paired_places(rows: DataFrame, max_distance: int) -> DataFrame:
    """(pair, contig, start, end, d5, d3, n_focal, n_passengers): the pairings of ``rows`` with equal intervals counted before they meet.

    A place stands for all reads on it, so the join grows with the places that are taken and not
    with the square of the reads on them; the pairs of two places are the product of both counts.
    """
    taken = rows.groupBy(*PAIR, "strand", "contig", "start", "end").agg(F.count(F.lit(1)).alias("count"))
    met = pairings(taken.withColumn("id", F.struct("contig", "start", "end", "count")), max_distance)
    return met.select(*PAIR, *[F.col(f"focal_id.{c}").alias(c) for c in ("contig", "start", "end")], "d5", "d3", F.col("focal_id.count").alias("n_focal"), F.col("passenger_id.count").alias("n_passengers"))


def farthest(rows: DataFrame, max_distance: int) -> DataFrame:
    """(pair, focal_id, d5): the largest d5 of every focal read that has a pairing; found by places, whose reads share it."""
    at = [*PAIR, "contig", "start", "end"]
    best = paired_places(rows, max_distance).groupBy(*at).agg(F.max("d5").alias("d5"))
    return rows.filter(F.col("strand") == "sense").join(best, at).select(*PAIR, F.col("id").alias("focal_id"), "d5")


def distances(rows: DataFrame, max_distance: int) -> DataFrame:
    """(pair, focal_id, d5, d3, n): the distances at which every focal read has pairings, and how many; found by places, whose reads share them."""
    at = [*PAIR, "contig", "start", "end"]
    met = paired_places(rows, max_distance).select(*at, "d5", "d3", F.col("n_passengers").alias("n"))
    # passengers on one place have one distance from a focal place, and other places another
    return rows.filter(F.col("strand") == "sense").join(met, at).select(*PAIR, F.col("id").alias("focal_id"), "d5", "d3", "n")


def recovery(rows: DataFrame, duplexes: DataFrame, geometry: tuple[int, int]) -> DataFrame:
    """Shares of focal sequences with any duplex and with the given geometry, by number and by abundance."""
    focal = rows.filter(F.col("strand") == "sense").select(*PAIR, F.col("id").alias("focal_id"), F.col("count").alias("focal_count"))
    hit = duplexes.groupBy(*PAIR, "focal_id").agg(F.max(((F.col("d5") == geometry[0]) & (F.col("d3") == geometry[1])).cast("int")).alias("_joint"))
    agg = focal.join(hit, [*PAIR, "focal_id"], "left").groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("n_focal"), F.sum("focal_count").alias("abundance"), F.count("_joint").alias("n_recovered"), F.coalesce(F.sum("_joint"), F.lit(0)).alias("n_joint"),
        F.coalesce(F.sum(F.when(F.col("_joint").isNotNull(), F.col("focal_count"))), F.lit(0)).alias("abundance_recovered"),
        F.coalesce(F.sum(F.when(F.col("_joint") == 1, F.col("focal_count"))), F.lit(0)).alias("abundance_joint"),
    )
    return agg.withColumns({
        "recovered": safe_ratio("n_recovered", "n_focal"), "joint": safe_ratio("n_joint", "n_focal"),
        "recovered_weighted": safe_ratio("abundance_recovered", "abundance"), "joint_weighted": safe_ratio("abundance_joint", "abundance"),
    })


def joint_spectrum(duplexes: DataFrame) -> DataFrame:
    """Count and share of each geometry within its run."""
    counts = duplexes.groupBy(*PAIR, "d5", "d3").agg(F.count(F.lit(1)).alias("n"))
    return A.share_of_total(counts, PAIR, "n", "fraction", "total")


def paired_spectrum(rows: DataFrame, max_distance: int) -> DataFrame:
    """``joint_spectrum`` of the pairings of ``rows``, none of which is emitted; the counts are stored once."""
    counts = paired_places(rows, max_distance).groupBy(*PAIR, "d5", "d3").agg(F.sum(F.col("n_focal") * F.col("n_passengers")).alias("n"))
    return A.share_of_total(Stored(counts, "spectrum").df, PAIR, "n", "fraction", "total")


def densified(spectrum: DataFrame, classes: Sequence[str], runs: Sequence[str], always: Sequence[tuple[int, int]]) -> DataFrame:
    """Every run of a class gets every geometry seen in the class, and the given ones; absent counts are 0."""
    seen = spectrum.select(*classes, "d5", "d3").distinct()
    extra = spectrum.select(*classes).distinct().select(*classes, F.inline(F.array(*[F.struct(F.lit(a).cast("long").alias("d5"), F.lit(b).cast("long").alias("d3")) for a, b in always])))
    geometries = seen.unionByName(extra).distinct()
    totals = spectrum.groupBy(*classes, *runs).agg(F.max("total").alias("total"))
    grid = totals.join(geometries, list(classes)) if classes else totals.crossJoin(geometries)
    full = grid.join(spectrum.select(*classes, *runs, "d5", "d3", "n"), [*classes, *runs, "d5", "d3"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("fraction", safe_ratio("n", "total"))


def conditioned(letters: DataFrame, background: DataFrame, keys: Sequence[str]) -> DataFrame:
    """log2 of a subset's letter share over the general share; NULL unless both are positive, misses counted as NULL."""
    joined = letters.join(background, list(keys), "left")
    return joined.withColumn("contrast", safe_log2_ratio("fraction", "general"))


def redundancy(a: DataFrame, b: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Rank correlation of two sources over their matched features."""
    from ..operators.statistics import spearman

    return spearman(a.join(b, [*keys, *features]), keys, "x", "y")


def focal_subset(rows: DataFrame, duplexes: DataFrame, geometry: tuple[int, int] | None = None) -> DataFrame:
    """Focal rows with a duplex, or with one of the given geometry."""
    hit = duplexes if geometry is None else duplexes.filter((F.col("d5") == geometry[0]) & (F.col("d3") == geometry[1]))
    return J.supported(rows.filter(F.col("strand") == "sense"), hit.select(*PAIR, F.col("focal_id").alias("id")), [*PAIR, "id"])

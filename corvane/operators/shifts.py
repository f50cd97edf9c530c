"""Circular-shift nulls of series of any length, block by block.

The statistic of a shift is (down - up) / (down + up): means of a track over the
``width`` bins behind and before the anchors, the track rolled by the shift, windows
cut at the ends of the series. A series is dealt as blocks of bins, the anchors as
blocks of anchors; a window's sum over a block of bins is a difference of two prefix
sums of that block, wherever the shift places it. Only pairs of an anchor block and a bin block that some
shift brings together meet, a bounded number of anchor blocks in a task, and
what leaves it is one partial sum for each replicate; replicates end in an aggregation.

Draws are digests: replicate r of a key takes allowed shift number (first 8 hexadecimal digits of the MD5 of
"seed|key|r") mod (number of allowed shifts), so any engine can repeat them and keys do not depend on each other.
Shifts farther than ``exclusion`` from both ends are allowed; if there are none, all but 0.

NULL or missing values of a track are 0 in its sums; bins are places in the order of
``bin_col`` (repeated bins are places of their own). Keys without an anchor or with fewer than two bins have no
rows. A replicate whose windows hold nothing, or only zeros, is NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Stored
from .order import beside
from .scan import key_text, numbered

#: Bins of a block, and anchor blocks that meet a bin block in one task.
BLOCK, ANCHOR_BLOCKS = 1 << 16, 64
#: Window sums worked out together.
STEP = 1 << 20


def shift_draws(lengths: DataFrame, keys: Sequence[str], n: str, replicates: int, exclusion: int, seed: int) -> DataFrame:
    """(keys, replicate, shift) for every key with two bins or more; key parts are joined by commas."""
    inner = F.col(n) - 1 - 2 * F.lit(exclusion)
    first, count = F.when(inner > 0, F.lit(exclusion) + 1).otherwise(F.lit(1)), F.when(inner > 0, inner).otherwise(F.col(n) - 1)
    drawn = lengths.filter(F.col(n) > 1).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    name = F.concat_ws(",", *[F.col(k).cast("string") for k in keys])
    digest = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), name, F.lit("|"), F.col("replicate").cast("string"))), 1, 8), 16, 10).cast("long")
    return drawn.withColumn("shift", (first + digest % count).cast("long"))


def _window_sums(prefix: np.ndarray, at: int, n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums over [begin, end) of a circular series of n bins, as far as the block [at, at + len) holds them; begin lies above -n."""
    size = prefix.shape[-1] - 1
    total = 0
    for image in (at, at - n):
        a, b = np.clip(begin - image, 0, size), np.clip(end - image, 0, size)
        total = total + prefix[:, b] - prefix[:, a]
    return total


def _block_sums(tracks: int, width: int):
    schema = pa.schema([("_key", pa.string()), ("shift", pa.int64()), *[(f"{s}{i}", pa.float64()) for i in range(tracks) for s in ("up", "down")]])

    def run(key: tuple, bins: pa.Table, pairs: pa.Table) -> pa.Table:
        if not bins.num_rows or not pairs.num_rows:
            return schema.empty_table()
        row = bins.slice(0, 1).to_pylist()[0]
        n, at = row["n"], row["block"] * row["size"]
        values = np.array([row[f"v{i}"] for i in range(tracks)], float)
        prefix = np.concatenate([np.zeros((tracks, 1)), np.cumsum(np.nan_to_num(values), axis=1)], axis=1)
        sums: dict[int, np.ndarray] = {}
        for p in pairs.to_pylist():
            anchors, shifts = np.array(p["anchors"], np.int64), np.array(p["shifts"], np.int64)
            step = max(1, STEP // max(1, len(anchors)))
            for lo in range(0, len(shifts), step):
                s = shifts[lo : lo + step, None]
                up = _window_sums(prefix, at, n, np.maximum(0, anchors - width) - s, anchors - s).sum(axis=2)
                down = _window_sums(prefix, at, n, anchors + 1 - s, np.minimum(n, anchors + 1 + width) - s).sum(axis=2)
                for j, shift in enumerate(shifts[lo : lo + step].tolist()):
                    one = np.stack([up[:, j], down[:, j]], axis=1)
                    sums[shift] = sums[shift] + one if shift in sums else one
        cols = [pa.array([row["_key"]] * len(sums), pa.string()), pa.array(list(sums), pa.int64())]
        both = np.array(list(sums.values())).reshape(len(sums), tracks, 2)
        return pa.Table.from_arrays([*cols, *[pa.array(both[:, i, k]) for i in range(tracks) for k in (0, 1)]], schema=schema)

    ddl = "_key string, shift long, " + ", ".join(f"{s}{i} double" for i in range(tracks) for s in ("up", "down"))
    return run, ddl


def shift_null(track: DataFrame, keys: Sequence[str], bin_col: str, tracks: Sequence[str], anchors: DataFrame, width: int, replicates: int = 200, exclusion: int = 5, seed: int = 0, block: int = BLOCK, draws: DataFrame | None = None) -> DataFrame:
    """(keys, replicate, shift, tracks): directionality of each track around the fixed anchors after each drawn shift.

    ``draws`` (keys, replicate, shift) takes the place of the digests', as those of ``resampling.generator_draws``.
    """
    placed = numbered(track.select(*keys, bin_col, *tracks), keys, [F.col(bin_col).asc()]).withColumn("_at", F.col("_row") - 1).drop("_row")
    placed = Stored(placed.withColumn("_key", key_text(keys)), "shift-places").df
    lengths = Stored(placed.groupBy(*keys, "_key").agg(F.count(F.lit(1)).alias("n")), "shift-lengths").df
    at = beside(anchors.select(*keys, F.col(bin_col).alias("_bin")).distinct(), placed.select(*keys, F.col(bin_col).alias("_bin"), "_key", "_at"), [*keys, "_bin"], "inner")
    marks = Stored(at.select("_key", "_at"), "shift-anchors").df
    if draws is None:
        given = shift_draws(lengths, keys, "n", replicates, exclusion, seed)
    else:
        given = beside(draws.select(*keys, "replicate", "shift"), lengths, keys, "inner").withColumn("shift", F.pmod(F.col("shift").cast("long"), F.col("n")))
    drawn = Stored(given, "shift-draws").df
    size = F.lit(block).cast("long")
    bins = placed.groupBy("_key", F.floor(F.col("_at") / size).alias("block")).agg(F.array_sort(F.collect_list(F.struct("_at", *[F.coalesce(F.col(t).cast("double"), F.lit(0.0)).alias(f"v{i}") for i, t in enumerate(tracks)]))).alias("_b"))
    bins = bins.select("_key", "block", size.alias("size"), *[F.col(f"_b.v{i}").alias(f"v{i}") for i in range(len(tracks))])
    bins = bins.join(lengths.select("_key", "n"), "_key")
    groups = Stored(marks.groupBy("_key", F.floor(F.col("_at") / size).alias("q")).agg(F.array_sort(F.collect_list("_at")).alias("anchors")), "shift-anchor-blocks").df
    # a shift brings an anchor block to the bins [first, last), which may wrap at either end
    shifts = drawn.select("_key", "n", "shift").distinct()
    reach = groups.select("_key", "q", F.array_min("anchors").alias("_lo"), F.array_max("anchors").alias("_hi")).join(shifts, "_key")
    first = F.greatest(F.lit(0), F.col("_lo") - width) - F.col("shift")
    last = F.least(F.col("n"), F.col("_hi") + 1 + width) - F.col("shift")
    # a negative place is one of the series' image before it
    parts = F.array(F.struct(F.greatest(first, F.lit(0)).alias("a"), last.alias("b")), F.struct((first + F.col("n")).alias("a"), (F.least(last, F.lit(0)) + F.col("n")).alias("b")))
    span = reach.select("_key", "q", "shift", F.explode(F.filter(parts, lambda x: x["a"] < x["b"])).alias("_p"))
    met = span.select("_key", "q", "shift", F.explode(F.sequence(F.floor(F.col("_p.a") / size), F.floor((F.col("_p.b") - 1) / size))).alias("block")).distinct()
    pairs = met.groupBy("_key", "q", "block").agg(F.collect_list("shift").alias("shifts")).join(groups, ["_key", "q"])
    pairs = pairs.withColumn("part", F.floor(F.col("q") / ANCHOR_BLOCKS)).select("_key", "block", "part", "shifts", "anchors")
    pairs = Stored(pairs, "shift-pairs").df
    tasks = pairs.select(*[F.col(c).alias(c) for c in ("_key", "block", "part")]).distinct()
    bins = bins.join(tasks, ["_key", "block"])
    run, ddl = _block_sums(len(tracks), width)
    by = ["_key", "block", "part"]
    partial = bins.groupBy(*by).cogroup(pairs.groupBy(*by)).applyInArrow(run, ddl)
    sums = partial.groupBy("_key", "shift").agg(*[F.sum(f"{s}{i}").alias(f"{s}{i}") for i in range(len(tracks)) for s in ("up", "down")])
    # how many bins the windows hold does not depend on the shift
    counts = marks.join(lengths.select("_key", "n"), "_key").groupBy("_key").agg(F.sum(F.least(F.col("_at"), F.lit(width))).alias("_up"), F.sum(F.least(F.col("n") - 1 - F.col("_at"), F.lit(width))).alias("_down"))
    joined = drawn.join(sums, ["_key", "shift"]).join(counts, "_key")

    def statistic(i: int) -> Column:
        up, down = F.try_divide(F.col(f"up{i}"), F.col("_up")), F.try_divide(F.col(f"down{i}"), F.col("_down"))
        return F.try_divide(down - up, down + up)

    return joined.select(*keys, "replicate", "shift", *[statistic(i).alias(t) for i, t in enumerate(tracks)])

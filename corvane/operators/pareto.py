"""Pareto fronts within strata (larger is better)."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Stored
from .order import beside
from .scan import key_text, numbered

#: Vectors of a stratum numbered in one task; vectors compared with each other in one task.
TASK_ROWS, COUNT_ROWS = 100_000, 8192


class _Front:
    """Staircase of (second, third) values of one front, second ascending and third descending."""

    def __init__(self) -> None:
        self.y: list[float] = []
        self.z: dict[float, float] = {}

    def covers(self, y: float, z: float) -> bool:
        i = bisect_right(self.y, y)
        if i and self.y[i - 1] == y:
            i -= 1
        return i < len(self.y) and self.z[self.y[i]] >= z

    def add(self, y: float, z: float) -> None:
        if self.covers(y, z):
            return
        i = bisect_right(self.y, y)
        while i and self.z[self.y[i - 1]] <= z:
            i -= 1
            self.z.pop(self.y.pop(i))
        insort(self.y, y)
        self.z[y] = z

    def rows(self) -> list[list[float]]:
        return [[y, self.z[y]] for y in self.y]


class _Points:
    """A front of points with any number of coordinates after the first."""

    def __init__(self) -> None:
        self.points: np.ndarray | None = None

    def covers(self, *rest: float) -> bool:
        return self.points is not None and bool((self.points >= np.array(rest)).all(axis=1).any())

    def add(self, *rest: float) -> None:
        point = np.array([rest])
        # what the new point covers decides nothing that it does not
        kept = self.points[~(point >= self.points).all(axis=1)] if self.points is not None else np.zeros((0, len(rest)))
        self.points = np.concatenate([kept, point])

    def rows(self) -> list[list[float]]:
        return self.points.tolist()


def number_points(points: list[tuple], fronts: list) -> list[int]:
    """Fronts of points in falling order after those that ``fronts`` already hold; ``fronts`` takes the points in."""
    out = []
    for first, *rest in points:
        lo, hi = 0, len(fronts)
        while lo < hi:
            mid = (lo + hi) // 2
            if fronts[mid].covers(*rest):
                lo = mid + 1
            else:
                hi = mid
        if lo == len(fronts):
            fronts.append(_Front() if len(rest) == 2 else _Points())
        fronts[lo].add(*rest)
        out.append(lo + 1)
    return out


def front_numbers(points: list[tuple]) -> list[int]:
    """Front of each of the distinct points, 1 the best, in their own order."""
    order = sorted(range(len(points)), key=lambda i: points[i], reverse=True)
    out = [0] * len(points)
    for i, front in zip(order, number_points([points[i] for i in order], []), strict=True):
        out[i] = front
    return out


def _padded(values: Sequence[str]) -> list[Column]:
    """Three values or more: missing ones are constant."""
    return [*[F.col(v).cast("double") for v in values], *[F.lit(0.0)] * (3 - len(values))]


def pareto_fronts(df: DataFrame, strata: Sequence[str], key: str, values: Sequence[str], out: str = "front", task_rows: int = TASK_ROWS) -> DataFrame:
    """Front number of every row over one value or more. Equal vectors collapse before the grouping, then share a front.

    A stratum of at most ``task_rows`` vectors is numbered in one task. Larger ones are dealt by
    falling vectors into range partitions, so that what dominates a point is in its partition or an earlier one;
    partition after partition is numbered, all strata at once, and only the fronts' outlines (points
    that no point of their front covers in the values after the first) are carried on.
    """
    names = [f"_p{i}" for i in range(max(3, len(values)))]
    vectors = df.dropna(subset=list(values)).select(*strata, *values, *[c.alias(n) for c, n in zip(_padded(values), names, strict=True)]).distinct()
    vectors = Stored(vectors.withColumn("_stratum", key_text(strata)), "pareto-vectors").df
    sizes = vectors.groupBy("_stratum").agg(F.count(F.lit(1)).alias("_rows"))
    large = Stored(sizes.filter(F.col("_rows") > task_rows), "pareto-large").df
    spec = f"_stratum string, {', '.join(f'{n} double' for n in names)}, {out} long"

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[["_stratum", *names]].sort_values(names, ascending=False, ignore_index=True)
        pdf[out] = number_points(list(pdf[names].itertuples(index=False, name=None)), [])
        return pdf

    most = large.agg(F.max("_rows")).first()[0]
    small = vectors.join(large.select("_stratum"), "_stratum", "left_anti") if most else vectors
    numbered = small.groupBy("_stratum").applyInPandas(whole, spec)
    if most:
        rest = vectors.join(large.select("_stratum"), "_stratum", "left_semi")
        numbered = numbered.unionByName(_large_fronts(rest, names, out, -(-rest.count() // task_rows)))
    by_vector = beside(vectors, Stored(numbered, "pareto-numbered").df, ["_stratum", *names]).select(*strata, *values, out)
    return beside(df, by_vector, [*strata, *values])


def _large_fronts(vectors: DataFrame, names: Sequence[str], out: str, parts: int) -> DataFrame:
    """(_stratum, names, out): strata over range partitions, numbered one partition after the other."""
    order = [F.col(n).desc() for n in names]
    dealt = Stored(vectors.select("_stratum", *names).repartitionByRange(parts, F.col("_stratum"), *order).withColumn("_part", F.spark_partition_id()), "pareto-dealt").df
    # partitions of a stratum are consecutive; its first is step 0, so all strata advance together
    firsts = dealt.groupBy("_stratum").agg(F.min("_part").alias("_from"))
    stepped = Stored(dealt.join(firsts, "_stratum").withColumn("_step", F.col("_part") - F.col("_from")).drop("_part", "_from"), "pareto-stepped").df
    schema = pa.schema([("_stratum", pa.string()), *[(n, pa.float64()) for n in names], (out, pa.int64()), ("outline", pa.list_(pa.list_(pa.float64())))])
    ddl = f"_stratum string, {', '.join(f'{n} double' for n in names)}, {out} long, outline array<array<double>>"

    def step(key: tuple, points: pa.Table, carried: pa.Table) -> pa.Table:
        known = sorted(carried.select([out, "outline"]).to_pylist(), key=lambda r: r[out])
        fronts = []
        for r in known:
            fronts.append(_Front() if len(names) == 3 else _Points())
            for point in r["outline"]:
                fronts[-1].add(*point)
        rows = sorted(zip(*(points.column(n).to_pylist() for n in names), strict=True), reverse=True)
        found = number_points(rows, fronts)
        text, nothing = key[0].as_py(), [None] * len(fronts)
        cols = [[text] * (len(rows) + len(fronts)), *[[r[i] for r in rows] + nothing for i in range(len(names))], found + list(range(1, len(fronts) + 1)), [None] * len(rows) + [f.rows() for f in fronts]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    last = stepped.agg(F.max("_step")).first()[0]
    carried, done = stepped.sparkSession.createDataFrame([], ddl), None
    for n in range(last + 1):
        here = stepped.filter(F.col("_step") == n).select("_stratum", *names)
        result = Stored(here.groupBy("_stratum").cogroup(carried.groupBy("_stratum")).applyInArrow(step, ddl), "pareto-step").df
        carried = result.filter(F.col("outline").isNotNull())
        numbered = result.filter(F.col("outline").isNull()).drop("outline")
        done = numbered if done is None else done.unionByName(numbered)
    return done


def dominance_count(df: DataFrame, strata: Sequence[str], key: str, values: Sequence[str], out: str = "n", task_rows: int = COUNT_ROWS) -> DataFrame:
    """(strata, key, out): how many rows of the stratum each row dominates, three values or fewer; rows that dominate none are left out.

    No pair is emitted. Vectors are dealt by rising order into range partitions of about
    ``task_rows``; what a vector dominates lies in its partition, counted there, or in an earlier one. Partitions
    meet by halves: at every level of a binary tree over the partitions the rows of a right half count
    those of the left half, which is the same question with one value less, and ends in running counts
    over range partitions (``operators.scan``).
    """
    if len(values) > 3:
        raise ValueError("at most three values are counted")
    names = ["_p0", "_p1", "_p2"]
    plain = df.dropna(subset=list(values)).select(*strata, key, *[c.alias(n) for c, n in zip(_padded(values), names, strict=True)]).withColumn("_stratum", key_text(strata))
    vectors = Stored(plain.groupBy("_stratum", *names).agg(F.count(F.lit(1)).alias("_w")).withColumn("_id", F.xxhash64("_stratum", *names)), "dominance-vectors").df
    rows = vectors.count()
    found = [c for c in _counts(vectors.withColumn("_asks", F.lit(True)).withColumn("_gives", F.lit(True)), names, max(1, -(-rows // task_rows)), task_rows)]
    total = found[0]
    for one in found[1:]:
        total = total.unionByName(one)
    # a vector counted itself and its equals
    counts = total.groupBy("_stratum", "_id").agg(F.sum("_c").alias("_c"))
    counted = vectors.join(counts, ["_stratum", "_id"]).select("_stratum", *names, (F.col("_c") - F.col("_w")).alias(out)).filter(F.col(out) > 0)
    return beside(plain, Stored(counted, "dominance-counts").df, ["_stratum", *names], "inner").select(*strata, key, out)


def _counts(rows: DataFrame, names: Sequence[str], parts: int, task_rows: int) -> list[DataFrame]:
    """(_stratum, _id, _c): weights ``_w`` of giving rows at or below each asking row in all ``names``, for rows of one ``_group`` (or ``_stratum``)."""
    group = [c for c in ("_stratum", "_group") if c in rows.columns]
    if len(names) == 1:
        # running weights in the order of the last value; equal values are at or below each other
        steps = rows.groupBy(*group, names[0]).agg(F.sum(F.when(F.col("_gives"), F.col("_w")).otherwise(0)).alias("_sum"))
        upto = numbered(steps, group, [F.col(names[0]).asc()], {"_sum": "_c"}).select(*group, names[0], "_c")
        return [rows.filter("_asks").join(upto, [*group, names[0]]).select("_stratum", "_id", "_c")]
    dealt = Stored(rows.repartitionByRange(parts, *group, *names).withColumn("_part", F.spark_partition_id()), "dominance-dealt").df
    cols = ["_id", "_w", "_asks", "_gives", *names]

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        give, ask = pdf[pdf["_gives"]], pdf[pdf["_asks"]]
        a, g, w = ask[list(names)].to_numpy(), give[list(names)].to_numpy(), give["_w"].to_numpy()
        step = max(1, (1 << 22) // max(1, len(g)))
        sums = [((g[None, :, :] <= a[lo : lo + step, None, :]).all(axis=2) * w).sum(axis=1) for lo in range(0, len(a), step)]
        return pd.DataFrame({"_stratum": ask["_stratum"], "_id": ask["_id"], "_c": np.concatenate(sums) if sums else np.zeros(0, np.int64)})

    local = dealt.groupBy(*group, "_part").applyInPandas(inside, "_stratum string, _id long, _c long")
    out = [local]
    most = dealt.agg(F.max("_part")).first()[0] or 0
    if most:
        bits = F.explode(F.sequence(F.lit(0), F.lit(most.bit_length() - 1)))
        tree = dealt.withColumn("_level", bits).withColumn("_right", F.expr("(shiftright(_part, _level) & 1) = 1"))
        name = F.concat_ws("|", *([F.col("_group")] if "_group" in group else []), F.col("_level").cast("string"), F.expr("shiftright(_part, _level + 1)").cast("string"))
        halves = tree.select("_stratum", name.alias("_group"), *[F.col(c) for c in cols if c not in ("_asks", "_gives")], (F.col("_asks") & F.col("_right")).alias("_asks"), (F.col("_gives") & ~F.col("_right")).alias("_gives"))
        halves = halves.filter(F.col("_asks") | F.col("_gives"))
        out += _counts(halves, names[1:], max(1, (most + 1) * most.bit_length()), task_rows)
    return out


def front_histogram(df: DataFrame, strata: Sequence[str], front: str = "front") -> DataFrame:
    return df.filter(F.col(front).isNotNull()).groupBy(*strata, front).agg(F.count(F.lit(1)).alias("n"))

"""Ranks and running sums over groups of any size: range partitions are summed locally, then shifted by what lies before them.

A window over one key sorts the whole key in one task. Here rows are dealt by
range of (keys, order), so a key of any size is spread over partitions; a
partition's own running values need only its own rows, and what precedes it is
one row for each partition and key. Rows that tie in keys and order stay in one partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import Stored


def key_text(keys: Sequence[str]) -> Column:
    """One text for each combination of keys, NULL included; lengths keep neighbours apart."""
    parts = [F.coalesce(F.concat(F.length(F.col(k).cast("string")).cast("string"), F.lit(":"), F.col(k).cast("string")), F.lit("-")) for k in keys]
    return F.concat(*parts) if parts else F.lit("")


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[Column], label: str = "scan", partitions: int | None = None) -> Stored:
    """The rows with ``_part`` (number of their range partition, which follows keys and order) and ``_key``, stored once."""
    by = [*[F.col(k).asc_nulls_first() for k in keys], *order]
    dealt = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    return Stored(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_key", key_text(keys)), label)


def running(stored: DataFrame, order: Sequence[Column], sums: dict[str, str], row: str = "_row") -> DataFrame:
    """Adds to ``ranged`` rows the row number within the key (from 1) and the running sums ``column -> name``, the row included."""
    totals = stored.groupBy("_part", "_key").agg(F.count(F.lit(1)).alias("_scan_rows"), *[F.sum(c).alias(f"_scan_{n}") for c, n in sums.items()])
    before = W.partitionBy("_key").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shift = totals.select("_part", "_key", F.coalesce(F.sum("_scan_rows").over(before), F.lit(0)).alias("_scan_rows"), *[F.coalesce(F.sum(f"_scan_{n}").over(before), F.lit(0)).alias(f"_scan_{n}") for n in sums.values()])
    here = W.partitionBy("_part", "_key").orderBy(*order)
    upto = here.rowsBetween(W.unboundedPreceding, 0)
    local = stored.withColumns({row: F.row_number().over(here), **{n: F.coalesce(F.sum(c).over(upto), F.lit(0)) for c, n in sums.items()}})
    joined = local.join(shift, ["_part", "_key"])
    return joined.withColumns({row: F.col(row) + F.col("_scan_rows"), **{n: F.col(n) + F.col(f"_scan_{n}") for n in sums.values()}}).drop("_scan_rows", *[f"_scan_{n}" for n in sums.values()])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: dict[str, str] | None = None, row: str = "_row", partitions: int | None = None) -> DataFrame:
    """Row numbers and running sums within ``keys``; names beginning with an underscore are the operator's."""
    return running(ranged(df, keys, order, "scan", partitions).df, order, sums or {}, row).drop("_part", "_key")


def with_halo(rows: DataFrame, row: str, block: int, ahead: int) -> DataFrame:
    """Numbered rows in blocks of ``block`` of their key, each block with the first ``ahead`` rows behind it.

    Adds ``_block`` and ``_own`` (whether the row is the block's own): a frame of up to ``ahead`` following rows lies in one block.
    """
    if ahead > block:
        raise ValueError("a block is shorter than what a frame looks ahead")
    place = F.col(row) - 1
    own = F.floor(place / block)
    lent = (place % block < ahead) & (own > 0)
    blocks = F.when(lent, F.array(own, own - 1)).otherwise(F.array(own))
    return rows.withColumn("_block", F.explode(blocks)).withColumn("_own", F.col("_block") == own)

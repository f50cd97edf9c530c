"""Exact duplicates by 128-bit content hash, with the bytes compared inside groups.

Built-in expressions only. Texts are grouped by the MD5 of the normalised
text; within each group of more than one row the normalised texts themselves
are grouping keys, so rows of one hash but other bytes fall apart. Counting
is pre-aggregated in the map tasks, and the way back from group to row goes
through a join that broadcasts the few hot groups.

Nulls count as empty texts; all empty texts are one group. A NULL id is
smaller than every other. Equal rows with equal ids all carry the same
keep_id, and one of them is kept. Extra columns are ignored by ``assign``
and carried by ``deduplicate``. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Stored
from .common import hot_join, if_small, lower_az

#: Duplicate hashes are broadcast up to this number (16 bytes each), joined by shuffle beyond.
HASHES_BROADCAST = 400_000


def _normal(text: str, fold: bool) -> Column:
    t = F.coalesce(F.col(text), F.lit(""))
    return lower_az(t) if fold else t


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", largest: bool = True, fold: bool = True, content_hash: Callable[[Column], Column] = F.md5) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) for every row; the largest (or smallest) id of a group stays."""
    norm = _normal(text, fold)
    rows = docs.select(F.col(key).alias("_id"), norm.alias("_t"))
    hashed = rows.select("_id", F.monotonically_increasing_id().alias("_row"), F.unhex(content_hash(F.col("_t"))).alias("_h"), F.sha2("_t", 256).alias("_s"))
    light = Stored(hashed, "exact-rows")
    total = light.df.count()
    best = F.max if largest else F.min
    # rows of one hash; single ones need no comparison
    by_hash = Stored(light.df.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"), best("_id").alias("_keep"), F.first("_s").alias("_s")), "exact-hashes")
    many = by_hash.df.filter("_n > 1").select("_h")
    texts = rows.select("_id", "_t", F.unhex(content_hash(F.col("_t"))).alias("_h")).join(if_small(many, HASHES_BROADCAST), "_h", "left_semi")
    # the text is a grouping key: equality of bytes decides, and copies collapse before the shuffle
    compared = texts.groupBy("_h", "_t").agg(F.count(F.lit(1)).alias("_n"), best("_id").alias("_keep")).select("_h", "_n", "_keep", F.sha2("_t", 256).alias("_s"))
    groups = Stored(by_hash.df.filter("_n = 1").select("_h", "_n", "_keep", "_s").unionByName(compared), "exact-groups")
    twice = groups.df.groupBy("_h", "_s").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").limit(1).count()
    if twice:
        raise RuntimeError("two texts agree in both digests but not in their bytes")
    out = hot_join(light.df, groups.df, ["_h", "_s"], "_n", total)
    repeated = Stored(light.df.groupBy("_h", "_s", "_id").agg(F.count(F.lit(1)).alias("_m"), F.min("_row").alias("_first")).filter("_m > 1"), "exact-repeats")
    is_keep = F.col("_id").eqNullSafe(F.col("_keep"))
    if repeated.df.limit(1).count():
        marks = repeated.df.select(F.struct("_h", "_s", "_id").alias("_k"), "_first", "_m")
        out = hot_join(out.withColumn("_k", F.struct("_h", "_s", "_id")), marks, ["_k"], "_m", total, "left")
        is_keep = is_keep & F.coalesce(F.col("_row") == F.col("_first"), F.lit(True))
    return out.select(F.col("_id").alias(key), F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"), is_keep.alias("kept"), F.col("_s").alias("text_sha256"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", largest: bool = True, fold: bool = True) -> DataFrame:
    """The rows that stay, with all their columns."""
    found = Stored(assign(docs, key, text, largest, fold), "exact-decisions")
    copies = found.df.filter("not kept").select(F.col(key).alias("_id"), F.col("text_sha256").alias("_s")).distinct()
    same = found.df.filter("kept").select(F.col(key).alias("_id"), F.col("text_sha256").alias("_s"))
    drop = copies.join(same, (copies["_id"].eqNullSafe(same["_id"])) & (copies["_s"] == same["_s"]), "left_anti")
    # rows travel as one column, so that no column of theirs can clash
    marked = docs.select(F.struct(*docs.columns).alias("_all"), F.col(key).alias("_id"), F.sha2(_normal(text, fold), 256).alias("_s"))
    kept = _without(marked, Stored(drop, "exact-drops").df)
    again = found.df.groupBy(key, "text_sha256").agg(F.count(F.lit(1)).alias("_m")).filter("_m > 1").limit(1).count()
    return (kept.dropDuplicates(["_id", "_s"]) if again else kept).select("_all.*")


def _without(marked: DataFrame, drop: DataFrame) -> DataFrame:
    gone = if_small(drop, HASHES_BROADCAST).withColumnsRenamed({"_id": "_gone_id", "_s": "_gone_s"})
    return marked.join(gone, F.col("_id").eqNullSafe(F.col("_gone_id")) & (F.col("_s") == F.col("_gone_s")), "left_anti")

"""Mixing sources to target weights by Pareto order sampling.

Built-in expressions only. Targets fill up to ``cap`` times a source's size,
the excess going to the others by weight. A source with target/size = c + f
takes c certain copies of every document; the fraction f is drawn by Pareto
order sampling with unequal probabilities: a document of n words has the weight
g = 10 + min(floor(log2 n), 10), so long documents are up to twice as likely as short
ones (``favour_long=False``: g = 10 for all), and p = min(1, lambda g) is its
inclusion probability, lambda being such that the expected words, p times n, sum to
the source's remaining target. Documents with p = 1 take one more certain copy. The others are ranked by random
odds over inclusion odds, (u/(1-u)) / (p/(1-p)), with u from the id's digest, and the leading documents
whose words fit the remaining target are taken. Further passes let smaller
documents of the ranking fill what is left, until none fits or the source is near its target (``near`` of it, or a word).
A source that is still farther off, as documents of very unequal sizes leave it, is then mended: one document
at a time, whichever brings it nearest, comes in or goes; and if it stays
short, the smallest document larger than what lacks comes in, the last of the ranking go for it,
and the nearer of both mixes stays. No document comes more often than ``cap`` times.

The cut in a ranking is found by narrowing ranges of the key: each step sums
words over 1,024 ranges of every source, so a source with any share of the
rows is never sorted in one task. Sources are ranked over range partitions.

Nulls: a NULL text has size 0, a NULL source is one source and comes last, a
NULL id draws as the text "null". An empty table gives an empty result, a text of any length
counts whole. Rows that tie in the key are taken or left
together. Size-0 rows take 0 words. Reruns agree, as all draws are digests.
Extra columns are ignored by ``plan`` and carried by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import Stored
from .common import WORD, hot_join

RANGES = 1024
#: A range with so few rows is cut by a window.
SMALL_RANGE = 4096
#: Sources up to this number are broadcast (under 100 bytes each).
SOURCES_BROADCAST = 100_000
#: A source is near its target within this share of it.
NEAR = 0.001


def source_key(source: str) -> Column:
    return F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))


def uniform(key: Column) -> Column:
    """A number in (0, 1) from 52 bits of the id's MD5."""
    digits = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 13), 16, 10)
    return (digits.cast("double") + 0.5) / F.lit(float(2**52))


def weight_of(size: Column, favour_long: bool = True) -> Column:
    """10 to 20, by the number of binary digits."""
    return (F.least(F.length(F.bin(size)), F.lit(11)) + 9).cast("bigint") if favour_long else F.lit(10).cast("bigint")


def place(key: Column, size: Column, favour_long: bool = True) -> Column:
    """Where a document stands in its source's ranking: odds q as q / (1 + q), certain documents at 0."""
    p, u = F.col("_lambda") * weight_of(size, favour_long), uniform(key)
    q = (u / (1 - u)) / (p / (1 - p))
    return F.when((size <= 0) | (p <= 0), F.lit(1.0)).when(p >= 1, F.lit(0.0)).otherwise(q / (1 + q))


def inclusion(rows: DataFrame, src: DataFrame, favour_long: bool = True) -> DataFrame:
    """(_k, _lambda): the factor that makes expected words equal ``_left``, from a source's sums by weight (11 rows at most)."""
    by = rows.filter("_size > 0").groupBy("_k", weight_of(F.col("_size"), favour_long).alias("_g")).agg(F.sum("_size").alias("_s"))
    by = by.join(src.select("_k", "_left"), "_k")
    above, here = W.partitionBy("_k").orderBy(F.col("_g").desc()).rowsBetween(W.unboundedPreceding, -1), W.partitionBy("_k").orderBy(F.col("_g").desc()).rowsBetween(0, W.unboundedFollowing)
    factor = (F.col("_left") - F.coalesce(F.sum("_s").over(above), F.lit(0))) / F.sum(F.col("_s") * F.col("_g")).over(here)
    # weights above the first that stays below certainty are certain
    fits = by.withColumn("_lambda", factor).filter("_lambda * _g <= 1")
    return fits.groupBy("_k").agg(F.max_by("_lambda", "_g").alias("_lambda"))


def sizes(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    return docs.select(F.col(key).alias("_id"), F.col(source).alias("_source"), source_key(source).alias("_k"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint").alias("_size"))


def source_targets(light: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """One row per source: size, documents, weight by rank, target."""
    spark = light.sparkSession
    by = light.groupBy("_k", "_source").agg(F.sum("_size").alias("_ssize"), F.count(F.lit(1)).alias("_docs"))
    order = F.col("_source").asc_nulls_last()
    parts = Stored(by.repartitionByRange(16, order).withColumn("_p", F.spark_partition_id()), "mix-sources")
    # at most one row per range partition
    offsets = parts.df.groupBy("_p").agg(F.count(F.lit(1)).alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranked = parts.df.join(F.broadcast(offsets.select("_p", "_before")), "_p").withColumn("_rank", F.row_number().over(W.partitionBy("_p").orderBy(order)) - 1 + F.col("_before"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    src = Stored(ranked.withColumn("_w", F.get(cycle, (F.col("_rank") % len(weights)).cast("int"))).drop("_p", "_before", "_rank"), "mix-ranked").df
    total, weight = src.agg(F.sum("_ssize"), F.sum("_w")).first()
    level = (total or 0) / weight if weight else 0.0
    while weight:
        full = F.col("_ssize") * F.lit(cap) < F.lit(level) * F.col("_w")
        capped, rest = src.agg(F.sum(F.when(full, F.col("_ssize") * F.lit(cap))), F.sum(F.when(~full, F.col("_w")))).first()
        risen = (total - (capped or 0.0)) / rest if rest else level
        if risen <= level:
            break
        level = risen
    return src.withColumn("_target", F.least(F.col("_ssize") * F.lit(cap), F.lit(level) * F.col("_w")))


def _to_sources(light: DataFrame, src: DataFrame, total: int, small: bool) -> DataFrame:
    return light.join(F.broadcast(src), "_k") if small else hot_join(light, src, ["_k"], "_docs", total)


def _narrow(rows: DataFrame, left: DataFrame) -> DataFrame:
    """(_k, _hi, _got): the largest key whose prefix of words fits ``_left``, over rows (_k, _v, _size, _left)."""
    state = rows.groupBy("_k").agg(F.first("_left").alias("_left"), F.min("_v").alias("_lo"), F.max("_v").alias("_up"), F.count(F.lit(1)).alias("_c"), F.sum("_size").alias("_sum"))
    state = state.withColumn("_base", F.lit(0).cast("bigint")).withColumn("_hi", F.lit(None).cast("double"))
    while True:  # a range of more than one key is cut in 1,024, so its width falls until it is small or one key
        state = Stored(state, "mix-ranges").df
        # sources that fit as a whole are settled, and so are small ranges
        big = state.filter((F.col("_base") + F.col("_sum") > F.col("_left")) & (F.col("_c") > SMALL_RANGE) & (F.col("_lo") < F.col("_up")))
        if not big.limit(1).count():
            break
        inside = rows.select("_k", "_v", "_size").join(F.broadcast(big), "_k").filter((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_up")))
        cell = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_up") - F.col("_lo")) * RANGES), F.lit(RANGES - 1)).alias("_cell")
        sums = inside.groupBy("_k", cell).agg(F.sum("_size").alias("_sum"), F.min("_v").alias("_lo"), F.max("_v").alias("_up"), F.count(F.lit(1)).alias("_c"))
        w = W.partitionBy("_k").orderBy("_cell")
        sums = sums.join(F.broadcast(big.select("_k", "_left", F.col("_base").alias("_b0"), F.col("_hi").alias("_h0"))), "_k")
        sums = sums.withColumn("_cum", F.col("_b0") + F.sum("_sum").over(w)).withColumn("_base", F.col("_cum") - F.col("_sum"))
        sums = sums.withColumn("_hi", F.coalesce(F.lag("_up").over(w), F.col("_h0")))
        edge = sums.filter((F.col("_cum") > F.col("_left")) & (F.col("_base") <= F.col("_left")))
        keep = ["_k", "_left", "_lo", "_up", "_c", "_sum", "_base", "_hi"]
        state = state.join(F.broadcast(big.select("_k")), "_k", "left_anti").select(*keep).unionByName(edge.select(*keep))
    whole = F.col("_base") + F.col("_sum") <= F.col("_left")
    settled = state.filter(whole).select("_k", F.col("_up").alias("_hi"), (F.col("_base") + F.col("_sum")).alias("_got"))
    open_ = state.filter(~whole)
    ties = rows.select("_k", "_v", "_size").join(F.broadcast(open_.drop("_c", "_sum")), "_k").filter((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_up")))
    ties = ties.groupBy("_k", "_v").agg(F.sum("_size").alias("_size"), F.first("_left").alias("_left"), F.first("_base").alias("_base"), F.first("_hi").alias("_hi"))
    cum = ties.withColumn("_cum", F.col("_base") + F.sum("_size").over(W.partitionBy("_k").orderBy("_v")))
    fits = F.col("_cum") <= F.col("_left")
    cut = cum.groupBy("_k").agg(F.coalesce(F.max(F.when(fits, F.col("_v"))), F.first("_hi")).alias("_hi"), F.coalesce(F.max(F.when(fits, F.col("_cum"))), F.first("_base")).alias("_got"))
    return settled.unionByName(cut)


_RULE, _FLIP = "array<struct<lo:double,hi:double,most:double>>", "array<struct<v:double,size:bigint,comes:boolean>>"


def chosen(v: Column, size: Column) -> Column:
    """Whether a document takes one copy beyond the certain ones: ranges that filled, ranges that went again, single exchanges."""
    took = F.exists("_rules", lambda r: (v > r["lo"]) & (v <= r["hi"]) & (size <= r["most"]))
    went = F.exists("_cuts", lambda r: (v > 0) & (v >= r["lo"]) & (v < r["hi"]) & (size <= r["most"]))
    comes = F.exists("_flips", lambda f: (f["v"] == v) & (f["size"] == size) & f["comes"])
    return (size > 0) & F.when(_flipped(v, size), comes).otherwise(took & ~went)


def _flipped(v: Column, size: Column) -> Column:
    return F.exists("_flips", lambda f: (f["v"] == v) & (f["size"] == size))


def _single() -> Column:
    """Documents that may be exchanged one by one, each once: drawn by odds, neither certain nor impossible."""
    return (F.col("_v") > 0) & (F.col("_v") < 1) & ~_flipped(F.col("_v"), F.col("_size"))


def _units(rows: DataFrame) -> DataFrame:
    """Rows of one place and size come and go together."""
    return rows.groupBy("_k", "_v", "_size", "_left").agg(F.sum("_size").alias("_sum"))


class _Mix:
    """Keyed rows and the sources' state; every step is a job over the rows of sources that are not settled."""

    def __init__(self, keyed: DataFrame, total: int, small: bool):
        self.keyed, self.total, self.small = keyed, total, small

    def rows(self, src: DataFrame, active: Column, *more: Column) -> DataFrame | None:
        """Rows of active sources beside their state, or None if all are settled."""
        now = src.filter(active).select("_k", "_docs", "_left", "_near", "_rules", "_cuts", "_flips", *more)
        return _to_sources(self.keyed, now, self.total, self.small).filter("_size > 0") if now.limit(1).count() else None

    def fill(self, src: DataFrame) -> DataFrame:
        """Passes over the ranking until no document fits what is left of any source."""
        lo = F.coalesce(F.try_element_at("_rules", F.lit(-1))["hi"], F.lit(-1.0))
        src = src.withColumn("_open", F.lit(True))
        while (rows := self.rows(src, F.col("_open") & (F.col("_left") > F.col("_near")), lo.alias("_from"))) is not None:
            fits = rows.filter((F.col("_size") <= F.col("_left")) & (F.col("_v") > F.col("_from")) & ~_flipped(F.col("_v"), F.col("_size")))
            got = _narrow(fits.select("_k", "_v", "_size", "_left"), src).filter(F.col("_hi").isNotNull() & (F.col("_got") > 0))
            rule = F.struct(lo.alias("lo"), F.col("_hi").alias("hi"), F.col("_left").alias("most"))
            nxt = src.join(got, "_k", "left").withColumn("_rules", F.when(F.col("_got").isNotNull(), F.array_append("_rules", rule)).otherwise(F.col("_rules")))
            src = Stored(nxt.withColumn("_open", F.col("_got").isNotNull()).withColumn("_left", F.col("_left") - F.coalesce("_got", F.lit(0))).drop("_hi", "_got"), "mix-sources-n").df
        return src.drop("_open")

    def empty(self, src: DataFrame) -> DataFrame:
        """The same from the end of the ranking, for sources that have too much."""
        hi = F.coalesce(F.try_element_at("_cuts", F.lit(-1))["lo"], F.lit(2.0))
        src = src.withColumn("_open", F.lit(True))
        while (rows := self.rows(src, F.col("_open") & (-F.col("_left") > F.col("_near")), hi.alias("_from"))) is not None:
            mine = chosen(F.col("_v"), F.col("_size")) & (F.col("_size") <= -F.col("_left")) & (F.col("_v") < F.col("_from")) & (F.col("_v") > 0) & ~_flipped(F.col("_v"), F.col("_size"))
            got = _narrow(rows.filter(mine).select("_k", (-F.col("_v")).alias("_v"), "_size", (-F.col("_left")).alias("_left")), src).filter(F.col("_hi").isNotNull() & (F.col("_got") > 0))
            rule = F.struct((-F.col("_hi")).alias("lo"), hi.alias("hi"), (-F.col("_left")).alias("most"))
            nxt = src.join(got, "_k", "left").withColumn("_cuts", F.when(F.col("_got").isNotNull(), F.array_append("_cuts", rule)).otherwise(F.col("_cuts")))
            src = Stored(nxt.withColumn("_open", F.col("_got").isNotNull()).withColumn("_left", F.col("_left") + F.coalesce("_got", F.lit(0))).drop("_hi", "_got"), "mix-sources-c").df
        return src.drop("_open")

    def _flip(self, src: DataFrame, units: DataFrame, rank: str) -> DataFrame:
        """Exchanges the first unit of each source by ``rank``."""
        first = units.groupBy("_k").agg(F.min(F.struct(F.col(rank).alias("_by"), "_v", "_size", "_sum")).alias("_b"))
        joined = src.join(first, "_k", "left").withColumn("_open", F.col("_b").isNotNull())
        flip = F.struct(F.col("_b._v").alias("v"), F.col("_b._size").alias("size"), (F.col("_left") > 0).alias("comes"))
        moved = F.when(F.col("_left") > 0, F.col("_left") - F.col("_b._sum")).otherwise(F.col("_left") + F.col("_b._sum"))
        return joined.withColumn("_flips", F.when(F.col("_open"), F.array_append("_flips", flip)).otherwise(F.col("_flips"))).withColumn("_left", F.when(F.col("_open"), moved).otherwise(F.col("_left"))).drop("_b")

    def exchange(self, src: DataFrame) -> DataFrame:
        """One document after another comes in or goes while that brings a source nearer."""
        src = src.withColumn("_open", F.lit(True))
        while (rows := self.rows(src, F.col("_open") & (F.abs("_left") > F.col("_near")))) is not None:
            able = rows.filter(_single() & (F.col("_size") < 2 * F.abs("_left")) & (chosen(F.col("_v"), F.col("_size")) == (F.col("_left") < 0)))
            off = F.abs(F.abs("_left") - F.col("_sum"))
            better = _units(able).withColumn("_off", off).filter(F.col("_off") < F.abs("_left"))
            src = Stored(self._flip(src, better, "_off"), "mix-exchange").df
        return src.drop("_open")

    def force(self, src: DataFrame) -> DataFrame:
        """Sources still short try the smallest document larger than what they lack, in place of the last of the ranking."""
        rows = self.rows(src, F.col("_left") > F.col("_near"))
        if rows is None:
            return src
        large = _single() & (F.col("_size") > F.col("_left")) & ~chosen(F.col("_v"), F.col("_size"))
        tried = Stored(self._flip(src.filter(F.col("_left") > F.col("_near")), _units(rows.filter(large)), "_sum"), "mix-forced").df.filter("_open").drop("_open")
        tried = self.exchange(self.empty(tried))
        state = ["_left", "_rules", "_cuts", "_flips"]
        other = tried.select(F.col("_k").alias("_k2"), *[F.col(c).alias(f"_try{c}") for c in state])
        nearer = F.coalesce(F.abs("_try_left") < F.abs("_left"), F.lit(False))
        joined = src.join(other, F.col("_k") == F.col("_k2"), "left").withColumn("_nearer", nearer)
        return Stored(joined.select(*[c for c in src.columns if c not in state], *[F.when(F.col("_nearer"), F.col(f"_try{c}")).otherwise(F.col(c)).alias(c) for c in state]), "mix-nearer").df


def decide(light: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, favour_long: bool = True, near: float = NEAR) -> tuple[DataFrame, DataFrame, int, bool]:
    """Keyed rows (_id, _source, _k, _size, _v), the sources with their rules, rows, and whether sources are few."""
    stored = Stored(light, "mix-rows").df
    total = stored.count()
    src = Stored(source_targets(stored, weights, cap), "mix-targets").df
    ratio = F.coalesce(F.try_divide(F.col("_target"), F.col("_ssize").cast("double")), F.lit(0.0))
    src = src.withColumn("_copies", F.floor(ratio)).withColumn("_f", ratio - F.col("_copies")).withColumn("_left", F.col("_target") - F.col("_copies") * F.col("_ssize"))
    src = src.join(inclusion(stored, src, favour_long), "_k", "left").withColumn("_lambda", F.coalesce("_lambda", F.lit(0.0)))
    src = src.withColumn("_near", F.greatest(F.lit(near) * F.col("_target"), F.lit(1.0)))
    src = Stored(src.withColumns({"_rules": F.array().cast(_RULE), "_cuts": F.array().cast(_RULE), "_flips": F.array().cast(_FLIP)}), "mix-sources-1").df
    small = src.count() <= SOURCES_BROADCAST
    keyed = Stored(_to_sources(stored, src.select("_k", "_lambda", "_docs"), total, small).select(*stored.columns, place(F.col("_id"), F.col("_size"), favour_long).alias("_v")), "mix-keys").df
    steps = _Mix(keyed, total, small)
    return keyed, steps.force(steps.exchange(steps.fill(src))), total, small


def taken_copies(v: Column, size: Column) -> Column:
    return F.col("_copies") + chosen(v, size).cast("bigint")


def plan(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, favour_long: bool = True) -> DataFrame:
    """(key, size, source_size, target, taken) of every row."""
    keyed, src, total, small = decide(sizes(docs, key, source, text), weights, cap, favour_long)
    out = _to_sources(keyed, src.select("_k", "_docs", "_ssize", "_target", "_copies", "_rules", "_cuts", "_flips"), total, small)
    return out.select(
        F.col("_id").alias(key), F.col("_size").alias("size"), F.col("_ssize").alias("source_size"), F.round("_target", 6).alias("target"),
        (F.col("_size") * taken_copies(F.col("_v"), F.col("_size"))).cast("bigint").alias("taken"),
    )


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, favour_long: bool = True) -> DataFrame:
    """The mixed corpus: every row as often as it is taken, with its columns. Texts are not shuffled while sources are few."""
    _, src, total, small = decide(sizes(docs, key, source, text), weights, cap, favour_long)
    # rows travel as one column, so that no column of theirs can clash
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")
    marked = docs.select(F.struct(*docs.columns).alias("_all"), F.col(key).alias("_id"), source_key(source).alias("_k"), size.alias("_size"))
    joined = _to_sources(marked, src.select("_k", "_docs", "_lambda", "_copies", "_rules", "_cuts", "_flips"), total, small)
    n = taken_copies(place(F.col("_id"), F.col("_size"), favour_long), F.col("_size")).cast("int")
    return joined.withColumn("_n", n).filter("_n > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("_all.*")

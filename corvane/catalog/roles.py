"""How the driver's tables play the roles of reads, backgrounds, targets, tracks and candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregates import rounded_mean

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

HEX, LETTERS, MASKED = "0123456789abcdef", "ACGTACGTACGTACGT", "ACGTACGTACGTACGN"


def query(name: str, sql: str | None = None):
    """Registers a query and the SQL that must give the same rows."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def tidy(df: DataFrame, digits: int = 8) -> DataFrame:
    """Doubles rounded and integers widened, as the comparison needs one type on both sides."""
    out = []
    for c, t in df.dtypes:
        if t == "double":
            out.append((F.round(c, digits) + F.lit(0.0)).alias(c))
        elif t in ("int", "smallint", "tinyint"):
            out.append(F.col(c).cast("bigint").alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def letters_of(x, masked: bool = False):
    return F.translate(F.sha2(x.cast("string"), 256), HEX, MASKED if masked else LETTERS)


def reads(spark: SparkSession, d: str) -> DataFrame:
    """sample, unit, grp, strand, length, count, identity, contig, start, end, id, discount, y of eligible pairs."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate")
    supplier = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, d, "nation").filter("n_regionkey <> 2")
    owners = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    start = F.datediff(F.col("l_shipdate"), F.lit("1992-01-01").cast("date")) % 200
    return li.join(owners, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("n_name").alias("sample"), F.col("l_returnflag").alias("unit"), F.col("n_regionkey").cast("bigint").alias("grp"),
        F.when(F.col("l_linestatus") == "O", "sense").otherwise("antisense").alias("strand"), F.col("l_quantity").cast("bigint").alias("length"),
        F.col("l_linenumber").cast("bigint").alias("count"), F.col("l_partkey").alias("identity"), (F.col("l_partkey") % 20).cast("string").alias("contig"),
        start.cast("bigint").alias("start"), (start + F.col("l_quantity").cast("bigint") - 1).alias("end"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        F.col("l_discount").alias("discount"), F.log("l_extendedprice").alias("y"),
    )


READS = """reads as (select n_name as sample, l_returnflag as unit, cast(n_regionkey as bigint) as grp,
 case when l_linestatus = 'O' then 'sense' else 'antisense' end as strand, cast(l_quantity as bigint) as length,
 cast(l_linenumber as bigint) as cnt, l_partkey as identity, cast(l_partkey % 20 as varchar) as contig,
 date_diff('day', date '1992-01-01', cast(l_shipdate as date)) % 200 as s, l_orderkey * 8 + l_linenumber as id, l_discount as discount, ln(l_extendedprice) as y
 from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey where n_regionkey <> 2)"""


def lettered(spark: SparkSession, d: str) -> DataFrame:
    """Reads of 23 and 24 letters with their sequence."""
    r = reads(spark, d).filter(F.col("length").isin(23, 24))
    return r.withColumn("sequence", F.substring(letters_of(F.col("identity")), F.lit(1), F.col("length").cast("int")))


LETTERED = f"""{READS}, lettered as (select *, substr(translate(sha256(cast(identity as varchar)), '{HEX}', '{LETTERS}'), 1, length) as seq
 from reads where length in (23, 24))"""


def background(spark: SparkSession, d: str) -> DataFrame:
    """Three masked 64-letter records for every pair."""
    pairs = reads(spark, d).select("sample", "unit").distinct()
    rec = pairs.withColumn("record", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return rec.withColumn("sequence", letters_of(F.concat_ws("|", "sample", "unit", F.col("record").cast("string")), masked=True))


BACKGROUND = f"""background as (select sample, unit, r as record, translate(sha256(sample || '|' || unit || '|' || cast(r as varchar)), '{HEX}', '{MASKED}') as seq
 from (select distinct sample, unit from reads), range(0, 3) t(r))"""


def targets(spark: SparkSession, d: str) -> DataFrame:
    """A 256-letter sequence for every nation."""
    parts = [letters_of(F.concat_ws("|", "n_name", F.lit(str(i)))) for i in range(4)]
    return table(spark, d, "nation").select(F.col("n_name").alias("target"), F.concat(*parts).alias("sequence"))


TARGETS = "targets as (select n_name as target, " + " || ".join(f"translate(sha256(n_name || '|{i}'), '{HEX}', '{LETTERS}')" for i in range(4)) + " as seq from nation)"

#: Annotated intervals of a target (fixed values).
INTERVALS = [(11, 80, "alpha"), (81, 150, "beta"), (171, 240, "omega")]


def intervals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INTERVALS, "istart int, iend int, label string")


def parts(spark: SparkSession, d: str) -> DataFrame:
    """Candidates: stratum, id, and three metrics."""
    disc = table(spark, d, "lineitem").groupBy("l_partkey").agg(rounded_mean("l_discount", 6).alias("m3"))
    p = table(spark, d, "part").select(F.col("p_brand").alias("stratum"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("m1"), F.col("p_size").cast("double").alias("m2"))
    # neither side is collected for a broadcast: both grow with the input
    return p.hint("merge").join(disc, p.id == disc.l_partkey).drop("l_partkey")


PARTS = """parts as (select p_brand as stratum, p_partkey as id, p_retailprice as m1, cast(p_size as double) as m2, m3 from part
 join (select l_partkey, round(avg(l_discount), 6) as m3 from lineitem group by 1) on l_partkey = p_partkey)"""

KINDS = ["click", "purchase", "signup", "view"]


def events(spark: SparkSession, d: str) -> DataFrame:
    """contig, minute, kind, value of the four track kinds."""
    minute = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))) / 60)
    return table(spark, d, "events").filter(F.col("event_type").isin(*KINDS)).select((F.col("user_id") % 20).alias("contig"), minute.cast("bigint").alias("minute"), F.col("event_type").alias("kind"), "value")


N_BINS, BIN = 720, 60
TRACK = f"""ev as (select user_id % 20 as contig, cast(floor((epoch(date_trunc('second', ts)) - epoch(timestamp '2024-01-01')) / 60) as bigint) as minute, event_type as kind, value
 from events where event_type in ('click', 'purchase', 'signup', 'view')),
 track0 as (select contig, minute // {BIN} as bin, """ + ", ".join(f"count(*) filter (kind = '{k}') as {k}" for k in KINDS) + f""" from ev group by all),
 track as (select c as contig, b as bin, """ + ", ".join(f"cast(coalesce({k}, 0) as double) as {k}" for k in KINDS) + f""" from (select distinct contig as c from track0), range(0, {N_BINS}) t(b)
 left join track0 on contig = c and bin = b)"""

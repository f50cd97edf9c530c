"""Queries of duplex geometry, conditioned contrasts and redundancy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import ranking as R
from ..plans import geometry as G
from .roles import LETTERED, READS, lettered, query, reads, tidy

FIXED = (1, -1)
DUP = f"""{READS}, rows0 as (select sample, unit, strand, contig, s as start, s + length - 1 as e, cnt, id from reads),
 dup as (select f.sample, f.unit, f.id as focal_id, p.id as passenger_id, f.cnt as focal_count, p.start - f.start as d5, p.e - f.e as d3 from rows0 f join rows0 p using (sample, unit, contig)
  where f.strand = 'sense' and p.strand = 'antisense' and abs(p.start - f.start) <= 3 and abs(p.e - f.e) <= 3),
 js as (select *, sum(n) over (partition by sample, unit) as total from (select sample, unit, d5, d3, count(*) as n from dup group by all)),
 grid as (select t.*, g.d5, g.d3 from (select distinct sample, unit, total from js) t, (select d5, d3 from js union select 0, 0 union select {FIXED[0]}, {FIXED[1]}) g),
 dj as (select sample, unit, d5, d3, total, coalesce(n, 0) as n, coalesce(n, 0) / total as fraction from grid left join js using (sample, unit, d5, d3, total))"""


def _dup(spark, d):
    r = reads(spark, d)
    return r, G.pairings(r, 3)


def _spectrum(spark, d):
    return G.paired_spectrum(reads(spark, d), 3)


@query("collapse_sequences", f"with {READS} select sample, unit, strand, identity, cast(sum(cnt) as bigint) as count from reads group by all")
def collapse_sequences(spark, d):
    return tidy(A.collapse(reads(spark, d), ["sample", "unit", "strand"], "identity", "count"))


@query("stable_ids", f"""with {READS} select distinct 'F' || substr(sha256(sample || chr(31) || unit || chr(31) || strand), 1, 24) as stable_id, regexp_replace(sample || '__' || unit || '__' || strand, '[^A-Za-z0-9_.-]+', '_', 'g') as run_id, sample, unit, strand from reads""")
def stable_ids(spark, d):
    r = reads(spark, d).select("sample", "unit", "strand").distinct()
    return r.withColumn("stable_id", S.stable_id("F", "sample", "unit", "strand")).withColumn("run_id", S.clean_identifier("sample", "unit", "strand"))


@query("opposite_strand_pairs", f"with {DUP} select sample, unit, cast(focal_id as bigint) as focal_id, cast(passenger_id as bigint) as passenger_id, focal_count, cast(d5 as bigint) as d5, cast(d3 as bigint) as d3 from dup")
def opposite_strand_pairs(spark, d):
    return tidy(_dup(spark, d)[1])


@query("recovery_fractions", f"""with {DUP}, h as (select sample, unit, focal_id, max(cast(d5 = {FIXED[0]} and d3 = {FIXED[1]} as int)) as j from dup group by all),
 a as (select sample, unit, count(*) as n_focal, sum(cnt) as abundance, count(j) as n_recovered, coalesce(sum(j), 0) as n_joint, coalesce(sum(cnt) filter (j is not null), 0) as ar, coalesce(sum(cnt) filter (j = 1), 0) as aj
  from (select sample, unit, id as focal_id, cnt from rows0 where strand = 'sense') left join h using (sample, unit, focal_id) group by all)
 select sample, unit, n_focal, cast(abundance as bigint) as abundance, n_recovered, cast(n_joint as bigint) as n_joint, cast(ar as bigint) as abundance_recovered, cast(aj as bigint) as abundance_joint,
 round(n_recovered / n_focal, 8) as recovered, round(n_joint / n_focal, 8) as joint, round(ar / abundance, 8) as recovered_weighted, round(aj / abundance, 8) as joint_weighted from a""")
def recovery_fractions(spark, d):
    r = reads(spark, d)
    return tidy(G.recovery(r, G.distances(r, 3), FIXED))


@query("joint_spectrum", f"with {DUP} select sample, unit, cast(d5 as bigint) as d5, cast(d3 as bigint) as d3, n, round(n / total, 8) as fraction, cast(total as bigint) as total from js")
def joint_spectrum(spark, d):
    return tidy(_spectrum(spark, d))


@query("joint_densified", f"with {DUP} select sample, unit, cast(d5 as bigint) as d5, cast(d3 as bigint) as d3, cast(total as bigint) as total, n, round(fraction, 8) as fraction from dj")
def joint_densified(spark, d):
    return tidy(G.densified(_spectrum(spark, d), [], G.PAIR, [(0, 0), FIXED]))


@query("joint_spectrum_balanced", f"""with {DUP}, s as (select d5, d3, sample, median(fraction) as f from dj group by all), b as (select d5, d3, median(f) as fraction, count(f) as n_members from s group by all),
 p as (select d5, d3, sum(n) / sum(total) as pooled from dj group by all) select cast(d5 as bigint) as d5, cast(d3 as bigint) as d3, round(fraction, 8) as fraction, n_members, round(pooled, 8) as pooled from b join p using (d5, d3)""")
def joint_spectrum_balanced(spark, d):
    dense = G.densified(_spectrum(spark, d), [], G.PAIR, [(0, 0), FIXED])
    bal = A.balanced_median(dense, [["d5", "d3", "sample"], ["d5", "d3"]], "fraction").drop("n_undefined")
    pool = dense.groupBy("d5", "d3").agg((F.sum("n") / F.sum("total")).alias("pooled"))
    return tidy(bal.join(pool, ["d5", "d3"]))


@query("joint_mode", f"""with {DUP}, m as (select *, max(n) over (partition by sample, unit) as top from js) select sample, unit, cast(min({{'a': d5, 'b': d3}}).a as bigint) as d5, cast(min({{'a': d5, 'b': d3}}).b as bigint) as d3, max(n) as n, count(*) as n_tied from m where n = top group by sample, unit""")
def joint_mode(spark, d):
    return tidy(A.mode_with_ties(_spectrum(spark, d), G.PAIR, ["d5", "d3"], "n"))


@query("strongest_indicator", f"with {DUP} select sample, unit, cast(d5 as bigint) as d5, cast(d3 as bigint) as d3, n, cast(n = max(n) over (partition by sample, unit) as bigint) as strongest from js")
def strongest_indicator(spark, d):
    return tidy(R.arg_max_flag(_spectrum(spark, d), G.PAIR, "n", "strongest").drop("fraction", "total"))


@query("paired_delta", f"""with {READS}, a as (select sample, unit, length, avg(cnt) as v from reads where length in (23, 24) group by all),
 p as (select sample, unit, max(v) filter (length = 23) as value_low, max(v) filter (length = 24) as value_high from a group by all) select sample, unit, round(value_low, 8) as value_low, round(value_high, 8) as value_high, round(value_high - value_low, 8) as delta from p""")
def paired_delta(spark, d):
    a = reads(spark, d).filter("length in (23, 24)").groupBy("sample", "unit", "length").agg(F.avg("count").alias("v"))
    return tidy(J.paired_difference(a, ["sample", "unit"], "length", 23, 24, "v"))


FIRST = """, share as (select sample, unit, letter, n / sum(n) over (partition by sample, unit) as general from (select sample, unit, substr(seq, 1, 1) as letter, count(*) as n from lettered group by all)),
 sub as (select sample, unit, letter, n / sum(n) over (partition by sample, unit) as fraction from (select sample, unit, substr(seq, 1, 1) as letter, count(*) as n from lettered where strand = 'sense' and cnt > 3 group by all))"""


def _first(df, out):
    c = df.groupBy("sample", "unit", F.substring("sequence", 1, 1).alias("letter")).agg(F.count(F.lit(1)).alias("n"))
    return A.share_of_total(c, ["sample", "unit"], "n", out).drop("n")


@query("conditioned_contrast", f"with {LETTERED}{FIRST} select sample, unit, letter, round(fraction, 8) as fraction, round(general, 8) as general, round(case when fraction > 0 and general > 0 then log2(fraction / general) end, 8) as contrast from sub left join share using (sample, unit, letter)")
def conditioned_contrast(spark, d):
    r = lettered(spark, d)
    return tidy(G.conditioned(_first(r.filter("strand = 'sense' and count > 3"), "fraction"), _first(r, "general"), ["sample", "unit", "letter"]))


@query("redundancy", f"""with {LETTERED}{FIRST}, x as (select letter, round(fraction, 9) as x, round(general, 9) as y from sub join share using (sample, unit, letter)),
 r as (select letter, rank() over (partition by letter order by x) + (count(*) over (partition by letter, x) - 1) / 2.0 as rx, rank() over (partition by letter order by y) + (count(*) over (partition by letter, y) - 1) / 2.0 as ry from x)
 select letter, round(corr(rx, ry), 8) as rho, count(*) as n from r group by 1""")
def redundancy(spark, d):
    r = lettered(spark, d)
    a = _first(r.filter("strand = 'sense' and count > 3"), "x").withColumn("x", F.round("x", 9))
    b = _first(r, "y").withColumn("y", F.round("y", 9))
    return tidy(G.redundancy(a, b, ["letter"], ["sample", "unit"]))

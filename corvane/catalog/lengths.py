"""Queries of the length landscape and the fixed composition."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bootstrap as Z
from ..operators import resampling as B
from ..operators import statistics as T
from ..plans import landscape as L
from .roles import READS, query, reads, tidy

LENGTHS = list(range(15, 36))
PAIRS = f"""{READS}, per as (select sample, unit, length, strand, sum(cnt) as a, count(distinct identity) as u from reads where length between 15 and 35 group by all),
 obs as (select sample, unit, length, sum(a) as a, sum(u) as u from per group by all),
 grid as (select sample, unit, l as length from (select distinct sample, unit from obs), range(15, 36) t(l)),
 dense as (select grid.*, coalesce(a, 0) as a, coalesce(u, 0) as u from grid left join obs using (sample, unit, length)),
 long as (select sample, unit, length, 'abundance' as mode, a as n from dense union all select sample, unit, length, 'unique_sequence', u from dense),
 lp as (select sample, unit, length, mode, cast(n as bigint) as n, cast(n as double) / nullif(sum(n) over w, 0) as fraction,
  case when sum(n) over w > 0 then rank() over (partition by sample, unit, mode order by n desc) end as rank from long window w as (partition by sample, unit, mode)),
 ls as (select sample, length, mode, median(fraction) as fraction, median(rank) as rank, count(fraction) as n_units from lp where fraction is not null group by all)"""


def _pairs(spark, d):
    return L.length_pairs(reads(spark, d), LENGTHS)


@query("length_landscape_pair", f"""with {PAIRS} select sample, unit, cast(length as bigint) as length, mode, n, round(fraction, 8) as fraction, cast(rank as bigint) as rank,
 cast(rank <= 1 as bigint) as top1, cast(rank <= 3 as bigint) as top3 from lp""")
def length_landscape_pair(spark, d):
    return tidy(_pairs(spark, d))


@query("length_landscape_sample", f"with {PAIRS} select sample, cast(length as bigint) as length, mode, round(fraction, 8) as fraction, round(rank, 8) as rank, n_units from ls")
def length_landscape_sample(spark, d):
    return tidy(L.length_samples(_pairs(spark, d)))


@query("length_landscape_dataset", f"""with {PAIRS}, t as (select length, mode, median(fraction) as fraction, median(rank) as rank, count(fraction) as n_samples from ls group by all),
 r as (select length, mode, avg(cast(rank <= 1 as int)) as top1_rate, avg(cast(rank <= 3 as int)) as top3_rate, count(rank) as n_pairs from lp group by all)
 select cast(length as bigint) as length, mode, round(fraction, 8) as fraction, round(rank, 8) as rank, n_samples, round(top1_rate, 8) as top1_rate, round(top3_rate, 8) as top3_rate, n_pairs from t join r using (length, mode)""")
def length_landscape_dataset(spark, d):
    return tidy(L.length_dataset(_pairs(spark, d)))


COMP = f"""{READS}, per as (select sample, unit, length, strand, sum(cnt) as a, count(distinct identity) as u from reads where length in (23, 24) group by all),
 long as (select sample, unit, length, strand, 'abundance' as mode, a as n from per union all select sample, unit, length, strand, 'unique_sequence', u from per),
 w as (select sample, unit, mode, coalesce(sum(n) filter (length = 23 and strand = 'sense'), 0) as ls, coalesce(sum(n) filter (length = 23 and strand = 'antisense'), 0) as la,
  coalesce(sum(n) filter (length = 24 and strand = 'sense'), 0) as hs, coalesce(sum(n) filter (length = 24 and strand = 'antisense'), 0) as ha from long group by all),
 cp as (select sample, unit, mode, ls / nullif(ls + la, 0) as sense_low, la / nullif(ls + la, 0) as antisense_low, hs / nullif(hs + ha, 0) as sense_high, ha / nullif(hs + ha, 0) as antisense_high,
  ha / nullif(hs + ha, 0) - la / nullif(ls + la, 0) as antisense_delta, (ls + la) / nullif(ls + la + hs + ha, 0) as low_share, (hs + ha) / nullif(ls + la + hs + ha, 0) as high_share from w)"""


@query("fixed_composition_pair", f"with {COMP} select sample, unit, mode, " + ", ".join(f"round({m}, 8) as {m}" for m in L.COMPOSITION) + " from cp")
def fixed_composition_pair(spark, d):
    return tidy(L.composition_pairs(reads(spark, d), 23, 24))


@query("fixed_composition_balanced", f"""with {COMP}, long2 as (select sample, unit, mode, metric, value from (""" + " union all ".join(f"select sample, unit, mode, '{m}' as metric, {m} as value from cp" for m in L.COMPOSITION) + """)),
 s as (select mode, metric, sample, median(value) as v from long2 group by all),
 sb as (select mode, metric, median(v) as sample_balanced, count(v) as n_members, count(*) - count(v) as n_undefined from s group by all),
 pb as (select mode, metric, median(value) as pair_balanced, count(value) as n_pairs from long2 group by all)
 select mode, metric, round(sample_balanced, 8) as sample_balanced, n_members, n_undefined, round(pair_balanced, 8) as pair_balanced, n_pairs from sb join pb using (mode, metric)""")
def fixed_composition_balanced(spark, d):
    return tidy(L.composition_balanced(L.composition_pairs(reads(spark, d), 23, 24)))


@query("leave_one_out_median", f"""with {PAIRS}, g as (select sample, median(fraction) as m from lp where length = 20 and mode = 'abundance' group by 1)
 select a.sample as omitted, round(median(b.m), 8) as estimate, count(b.m) as n_groups from g a join g b on a.sample <> b.sample group by 1""")
def leave_one_out_median(spark, d):
    p = _pairs(spark, d).filter("length = 20 and mode = 'abundance'")
    return tidy(T.leave_one_out_median(p, "sample", "fraction"))


REPS = 50


@query("bootstrap_ci", f"""with {PAIRS}, v as (select length, list(fraction order by sample) as v from ls where mode = 'abundance' and fraction is not null group by 1),
 drawn as (select length, b, v[1 + cast('0x' || substr(sha256(cast(b as varchar) || '|' || cast(i as varchar)), 1, 8) as bigint) % len(v)] as x
  from v, range(0, {REPS}) tb(b), range(0, 1000) ti(i) where i < len(v)),
 e as (select length, b, median(x) as e from drawn group by all)
 select cast(length as bigint) as length, round(quantile_cont(e, 0.025), 8) as ci_low, round(quantile_cont(e, 0.975), 8) as ci_high, count(*) as replicates from e group by 1""")
def bootstrap_ci(spark, d):
    s = L.length_samples(_pairs(spark, d)).filter("mode = 'abundance'")
    return tidy(B.bootstrap_median_ci_sql(s, ["length"], "fraction", "sample", REPS))


@query("clustered_bootstrap", f"""with {PAIRS}, m as (select length, mode, sample, median(fraction) as m from lp group by all having median(fraction) is not null), v as (select length, mode, list(m order by sample) as v, median(m) as estimate from m group by all),
 dr as (select length, mode, b, v[1 + cast('0x' || substr(sha256(cast(b as varchar) || '|' || cast(i as varchar)), 1, 8) as bigint) % len(v)] as x from v, range(0, {4 * REPS}) tb(b), range(0, 1000) ti(i) where i < len(v)),
 e as (select length, mode, b, median(x) as e from dr group by all), c as (select length, mode, quantile_cont(e, 0.025) as lo, quantile_cont(e, 0.975) as hi, count(*) as replicates from e group by all)
 select cast(length as bigint) as length, mode, round(estimate, 8) as estimate, round(lo, 8) as ci_low, round(hi, 8) as ci_high, replicates, cast(len(v) as bigint) as n_clusters from v join c using (length, mode)""")
def clustered_bootstrap(spark, d):
    return tidy(Z.clustered_median_ci(_pairs(spark, d), ["length", "mode"], "sample", "fraction", 4 * REPS))


@query("hierarchical_bootstrap_spread")
def hierarchical_bootstrap_spread(spark, d):
    """Suppliers' orders within nations: rows of a cluster grow with the tables."""
    return Z.hierarchical_median_ci(reads(spark, d), ["unit", "strand"], "sample", "discount", 200, 20260810)


@query("bootstrap_mt19937")
def bootstrap_mt19937(spark, d):
    s = _pairs(spark, d).filter(F.col("fraction").isNotNull())
    return B.bootstrap_median_ci(s, ["length", "mode"], "sample", "fraction", 500, 20260814, "mt19937")


@query("hierarchical_bootstrap")
def hierarchical_bootstrap(spark, d):
    s = _pairs(spark, d).filter(F.col("fraction").isNotNull())
    return B.hierarchical_bootstrap_ci(s, ["length", "mode"], "sample", "fraction", 200, 20260810)


def _null_sql(group: str | None) -> str:
    med = lambda src, keys: f"select {keys}, median(v) as v from {src} group by all" if group else f"select {keys}, v from {src}"
    return f"""with {READS}, o as (select strand, sample, unit, round(avg(discount), 9) as v from reads where id % 7 = 0 group by all),
 nl as (select strand, sample, unit, id % 19 as rep, round(avg(discount), 9) as v from reads group by all), og as ({med("o", "strand, sample")}), ng as ({med("nl", "strand, rep, sample")}),
 e as (select strand, median(v) as estimate, count(*) as n_groups from og group by 1), nr as (select strand, rep, median(v) as v from ng group by all),
 t as (select strand, estimate, n_groups, count(*) filter (v >= estimate) as n_exceed, count(v) as n_null from e join nr using (strand) group by all), p as (select *, (n_exceed + 1) / (n_null + 1) as p, (select count(*) from o where o.strand = t.strand) as n_rows from t),
 i as (select *, row_number() over (order by p, strand) as i, count(*) over () as m from p)
 select strand, round(estimate, 8) as estimate, n_groups, n_rows, n_exceed, n_null, round(p, 8) as p, round(least(1.0, min(p * m / i) over (order by i desc)), 8) as q from i"""


def _null_results(spark, d, group):
    r = reads(spark, d)
    observed = r.filter("id % 7 = 0").groupBy("strand", "sample", "unit").agg(F.round(F.avg("discount"), 9).alias("v"))
    nulls = r.groupBy("strand", "sample", "unit", (F.col("id") % 19).alias("rep")).agg(F.round(F.avg("discount"), 9).alias("v"))
    return tidy(T.null_results(observed, nulls, ["strand"], "rep", "v", group))


@query("null_results_pair", _null_sql(None))
def null_results_pair(spark, d):
    return _null_results(spark, d, None)


@query("null_results_sample", _null_sql("sample"))
def null_results_sample(spark, d):
    return _null_results(spark, d, "sample")

"""Queries of reconciled and completed runs, and of letters conditioned on a geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import conditioning as K
from ..plans import geometry as G
from .geometry import DUP, FIXED
from .letters import TERM, _enr, _exp
from .roles import lettered, query, reads, tidy
from .validation import _faults

RUN = ["sample", "unit", "length"]
BASE = f"""{DUP}, runs as (select f.sample, f.unit, f.e - f.start + 1 as length, f.id as focal_id, p.e - p.start + 1 as passenger_length, p.start - f.start as d5, p.e - f.e as d3 from rows0 f join rows0 p using (sample, unit, contig)
  where f.strand = 'sense' and p.strand = 'antisense' and abs(p.start - f.start) <= 3 and abs(p.e - f.e) <= 3 and f.e - f.start + 1 in (23, 24)),
 foc as (select sample, unit, length, id as focal_id, cnt from reads where strand = 'sense' and length in (23, 24))"""


def _runs(spark, d):
    """Focal reads, passengers and pairs of the runs of 23 and 24 letters."""
    r = reads(spark, d)
    focals = r.filter("strand = 'sense' and length in (23, 24)").select(*RUN, F.col("id").alias("focal_id"), "count")
    passengers = r.filter("strand = 'antisense'").select("sample", "unit")
    # ids carry the length, which the pairs then have of both reads
    pairs = G.pairings(r.filter("strand = 'antisense' or length in (23, 24)").withColumn("id", F.struct("id", "length")), 3)
    duplexes = pairs.select("sample", "unit", F.col("focal_id.length").alias("length"), F.col("focal_id.id").alias("focal_id"), F.col("passenger_id.length").alias("passenger_length"), "d5", "d3")
    return focals, passengers, duplexes


@query("run_reconciliation", f"""with {BASE}, cl as (select sample, unit, length, passenger_length, count(*) as c from runs group by all), cn as (select sample, unit, length, focal_id, coalesce(max(k), 0) as c from foc left join (select sample, unit, length, focal_id, count(*) as k from runs group by all) using (sample, unit, length, focal_id) group by all),
 c5 as (select sample, unit, length, d5 as k, count(*) as c from runs group by all), c3 as (select sample, unit, length, d3 as k, count(*) as c from runs group by all),
 part as (select sample, unit, length, 'l' as w, c, c + case when passenger_length = 30 then 1 else 0 end as d, passenger_length = 31 as twice from cl
  union all select sample, unit, length, 'n', c, case when focal_id % 61 = 0 then null else c end, false from cn
  union all select sample, unit, length, '5', c, case when k = 0 and sample = 'NATION_3' then c + 1 else c end, false from c5 union all select sample, unit, length, '3', c, c, false from c3
  union all select sample, unit, length, '3', null, 2, false from (select distinct sample, unit, length from c3 where unit = 'R')),
 agg as (select sample, unit, length, sum(c) filter (w = '5') as n, 0 as unknown_focal, count(*) filter (w = 'l' and (c <> d or twice)) as by_length, count(*) filter (w = 'n' and d is null) as by_focal, count(*) filter (w = '5' and c <> d) as end5, 0 as end3,
  cast(coalesce(sum(d) filter (w = '5'), 0) <> coalesce(sum(c) filter (w = '5'), 0) as int) as total5, cast(coalesce(sum(d) filter (w = '3'), 0) <> coalesce(sum(c) filter (w = '3'), 0) as int) as total3, count(*) filter (twice) as repeated from part group by all),
 named as (select sample || ':' || unit || ':' || length as scope, * from agg) select 'run' as "check", scope, {_faults(K.RUN_FAULTS)} from named""")
def run_reconciliation(spark, d):
    """Declared tables that are right but for length 30 (one too many), 31 (declared twice), some focal reads (absent), one sample's d5 and one unit's d3."""
    focals, _, dup = _runs(spark, d)
    n = F.count(F.lit(1))
    lengths = dup.groupBy(*RUN, "passenger_length").agg(n.alias("n")).withColumn("n", F.col("n") + F.when(F.col("passenger_length") == 30, 1).otherwise(0))
    lengths = lengths.unionByName(lengths.filter("passenger_length = 31"))
    counted = dup.groupBy(*RUN, "focal_id").agg(n.alias("n"))
    numbers = focals.select(*RUN, "focal_id").distinct().join(counted, [*RUN, "focal_id"], "left").na.fill(0, ["n"]).filter("focal_id % 61 <> 0")
    ends = dup.select(*RUN, F.inline(F.array(*[F.struct(F.lit(e).alias("end"), F.col(e).alias("distance")) for e in ("d5", "d3")])))
    spectrum = ends.groupBy(*RUN, "end", "distance").agg(n.alias("n"))
    off = F.when((F.col("sample") == "NATION_3") & (F.col("end") == "d5") & (F.col("distance") == 0), 1).otherwise(0)
    extra = spectrum.filter("unit = 'R'").select(*RUN, F.lit("d3").alias("end"), F.lit(99).cast("long").alias("distance"), F.lit(2).cast("long").alias("n")).distinct()
    return K.reconcile_runs(focals, dup, lengths, numbers, spectrum.withColumn("n", F.col("n") + off).unionByName(extra), RUN)


@query("completed_runs", f"""with {BASE}, dim as (select sample, unit, l as length from (select distinct sample, unit from reads), (select unnest([22, 23, 24]) as l)),
 hit as (select sample, unit, length, focal_id, count(*) as pairs, count(*) filter (d5 = {FIXED[0]} and d3 = {FIXED[1]}) as j from runs group by all),
 per as (select sample, unit, length, count(*) as n_focal, count(pairs) as n_recovered, count(*) filter (j > 0) as n_joint, sum(pairs) as n_duplexes, sum(j) as n_joint_duplexes, sum(cnt) as abundance, sum(cnt) filter (pairs > 0) as abundance_recovered, sum(cnt) filter (j > 0) as abundance_joint
  from foc left join hit using (sample, unit, length, focal_id) group by all),
 pool as (select sample, unit, count(*) as n_passengers from reads where strand = 'antisense' and unit <> 'A' group by all),
 u as (select sample, unit, cast(length as bigint) as length, {", ".join(f"cast(coalesce({c}, 0) as bigint) as {c}" for c in ("n_focal", "n_recovered", "n_joint", "n_duplexes", "n_joint_duplexes", "abundance", "abundance_recovered", "abundance_joint", "n_passengers"))} from dim left join per using (sample, unit, length) left join pool using (sample, unit))
 select *, case when n_focal = 0 then 'zero_focal' when n_passengers = 0 then 'zero_passenger_pool' when n_recovered = 0 then 'zero_recovered' else 'recovered' end as status, round(n_recovered / nullif(n_focal, 0), 8) as recovered, round(abundance_recovered / nullif(abundance, 0), 8) as recovered_weighted,
 round(n_joint / nullif(n_focal, 0), 8) as joint, round(abundance_joint / nullif(abundance, 0), 8) as joint_weighted, round(n_joint / nullif(n_recovered, 0), 8) as joint_of_recovered, round(abundance_joint / nullif(abundance_recovered, 0), 8) as joint_of_recovered_weighted,
 round(n_joint_duplexes / nullif(n_duplexes, 0), 8) as joint_of_duplexes from u""")
def completed_runs(spark, d):
    """Runs of 22 letters have no focal reads here, those of unit A no pool."""
    focals, passengers, dup = _runs(spark, d)
    dim = reads(spark, d).select("sample", "unit").distinct().withColumn("length", F.explode(F.array(*[F.lit(k).cast("long") for k in (22, 23, 24)])))
    return tidy(K.complete_runs(dim, focals, passengers.filter("unit <> 'A'"), dup, RUN, ["sample", "unit"], FIXED))


@query("run_length_contrasts", f"""with {BASE}, hit as (select distinct sample, unit, length, focal_id, true as h from runs), per as (select sample, unit, length, count(h) / count(*) as recovered, sum(cnt) filter (h) / sum(cnt) as rw from foc left join hit using (sample, unit, length, focal_id) group by all),
 long as (select sample, unit, length, 'recovered' as metric, recovered as v from per union all select sample, unit, length, 'recovered_weighted', coalesce(rw, 0) from per),
 dl as (select sample, unit, metric, max(v) filter (length = 24) - max(v) filter (length = 23) as delta from long group by all), s as (select metric, sample, median(delta) as delta from dl group by all)
 select metric, round(median(delta), 8) as delta, count(delta) as n_members, count(*) - count(delta) as n_undefined from s group by 1""")
def run_length_contrasts(spark, d):
    focals, passengers, dup = _runs(spark, d)
    rows = K.complete_runs(focals, focals, passengers, dup, RUN, ["sample", "unit"], FIXED)
    return tidy(K.length_contrasts(rows, ["recovered", "recovered_weighted"], 23, 24, keys=()))


NEAR = 12
COND = f"""{TERM}, dup as (select f.id as focal_id, p.s - f.s as d5 from lettered f join reads p using (sample, unit, contig) where f.strand = 'sense' and p.strand = 'antisense' and abs(p.s - f.s) <= {NEAR} and abs(p.s + p.length - f.s - f.length) <= {NEAR}),
 fr as (select sample, unit, length, strand, seq, cnt, id, id in (select focal_id from dup) as rec, id in (select focal_id from dup where d5 >= 0) as joi from lettered where strand = 'sense'),
 tt as (select sample, unit, length, strand, count(*) as n_focal, count(*) filter (rec) as n_recovered, count(*) filter (joi) as n_joint, coalesce(sum(cnt) filter (rec), 0) as ra, coalesce(sum(cnt) filter (joi), 0) as ja from fr group by all),
 lt as (select sample, unit, length, strand, position, letter, sum(cnt) filter (rec) as lra, count(*) filter (rec) as lru, sum(cnt) filter (joi) as lja, count(*) filter (joi) as lju
  from fr, lateral (select unnest(['5p1', '5p2', '3p2', '3p1']) as position, unnest([substr(fr.seq, 1, 1), substr(fr.seq, 2, 1), substr(fr.seq, length(fr.seq) - 1, 1), substr(fr.seq, length(fr.seq), 1)]) as letter) group by all),
 gg as (select * from tt, (select unnest(['5p1', '5p2', '3p2', '3p1']) as position), (select unnest(['A', 'C', 'G', 'T']) as letter), (select unnest(['abundance', 'unique_sequence']) as mode)),
 cf as (select gg.sample, gg.unit, gg.length, gg.strand, gg.position, gg.letter, gg.mode, n_focal, n_recovered, n_joint, case when gg.mode = 'abundance' then ja else n_joint end as joint_total, case when gg.mode = 'abundance' then ra else n_recovered end as recovered_total,
  coalesce(case when gg.mode = 'abundance' then lja else lju end, 0) / nullif(case when gg.mode = 'abundance' then ja else n_joint end, 0) as joint_fraction,
  coalesce(case when gg.mode = 'abundance' then lra else lru end, 0) / nullif(case when gg.mode = 'abundance' then ra else n_recovered end, 0) as recovered_fraction, exp.expected, enr.ratio as general_ratio, exp.sample is not null as has_expected, enr.sample is not null as has_general
  from gg left join lt using (sample, unit, length, strand, position, letter) left join exp using (sample, unit, length, strand, position, letter) left join enr using (sample, unit, length, strand, position, letter, mode)),
 cr as (select *, case when expected > 0 then joint_fraction / expected end as joint_ratio, case when expected > 0 then recovered_fraction / expected end as recovered_ratio from cf),
 cond as (select *, case when joint_ratio > 0 and general_ratio > 0 then log2(joint_ratio / general_ratio) end as joint_vs_general, case when joint_ratio > 0 and recovered_ratio > 0 then log2(joint_ratio / recovered_ratio) end as joint_vs_recovered from cr)"""


def _near(spark, d):
    """Focal reads of 23 and 24 letters, and the largest 5' distance of those that have a pair with both ends near."""
    r = reads(spark, d).filter("strand = 'antisense' or length in (23, 24)")
    return lettered(spark, d).filter("strand = 'sense'"), G.farthest(r, NEAR).withColumnRenamed("focal_id", "id")


def _conditioned(spark, d):
    focals, dup = _near(spark, d)
    exp = _exp(spark, d)
    return K.conditioned_letters(K.flag_focals(focals, dup, dup.filter("d5 >= 0"), ["id"]), exp, _enr(spark, d, exp))


@query("conditioned_letters", f"""with {COND} select sample, unit, cast(length as bigint) as length, strand, position, letter, mode, n_focal, n_recovered, n_joint, cast(joint_total as bigint) as joint_total, cast(recovered_total as bigint) as recovered_total, has_expected, has_general,
 {", ".join(f"round({c}, 8) as {c}" for c in ["expected", "general_ratio", *K.CONDITIONED])} from cond""")
def conditioned_letters(spark, d):
    return tidy(_conditioned(spark, d))


@query("conditioned_summary", f"""with {COND}, l as (select length, strand, mode, position, letter, sample, unnest({K.CONDITIONED}) as metric, unnest([{", ".join(K.CONDITIONED)}]) as v from cond), s as (select length, strand, mode, position, letter, metric, sample, median(v) as m from l group by all)
 select cast(length as bigint) as length, strand, mode, position, letter, metric, round(median(m), 8) as value, count(m) as n_members, count(*) - count(m) as n_undefined from s group by all""")
def conditioned_summary(spark, d):
    return tidy(K.conditioned_summary(_conditioned(spark, d)))


@query("conditioned_misses", f"""with {COND}, r as (select count(*) filter (n_joint = 0) as j, count(*) filter (n_recovered = 0) as r from tt) select count(*) filter (not has_expected) as missing_expected, count(*) filter (not has_general) as missing_general, any_value(j) as empty_joint, any_value(r) as empty_recovered, 0.0::double as max_deviation from cond, r""")
def conditioned_misses(spark, d):
    return tidy(K.miss_counters(_conditioned(spark, d)))


@query("subset_checks", f"""with {COND}, k as (select id, count(*) as f from fr where length = 23 group by 1), p as (select focal_id as id, max(d5) <> 0 as r, max(d5) >= 0 as j from dup group by 1),
 u as (select f, coalesce(r, false) as r, coalesce(j, false) as j from k full join p using (id))
 select 'subsets' as "check", 'all' as scope, {_faults(["unknown_recovered", "unknown_joint", "outside_recovered", "repeated"])} from (select sum(f) as n, count(*) filter (r and f is null) as unknown_recovered, count(*) filter (j and f is null) as unknown_joint, count(*) filter (j and not r) as outside_recovered, count(*) filter (f > 1) as repeated from u)""")
def subset_checks(spark, d):
    """Of focal reads of 23 letters only, and recovered reads without those whose farthest 5' distance is 0."""
    focals, dup = _near(spark, d)
    far = dup.groupBy("id").agg(F.max("d5").alias("d")).filter("d <> 0")
    return K.subset_checks(focals.filter("length = 23"), far, dup.filter("d5 >= 0"), ["id"])

"""Queries of candidate windows, regression, layers, fronts and regions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import sequence as S
from ..operators import joins as J
from ..operators import pareto as P
from ..operators import ranking as R
from ..operators import regression as G
from ..plans import candidates as C
from .roles import INTERVALS, LETTERED, PARTS, TARGETS, intervals, lettered, parts, query, targets, tidy

IV = "iv as (select * from (values " + ", ".join(str(x) for x in INTERVALS) + ") t(istart, iend, label))"
RCR = lambda s: f"reverse(translate({s}, 'ACGU', 'UGCA'))"
WIN = f"""{TARGETS}, win as (select target, target || '__' || k || 'nt__' || lpad(cast(s as varchar), 4, '0') || '_' || lpad(cast(s + k - 1 as varchar), 4, '0') as window_id, k as length, s as start, s + k - 1 as e,
  substr(seq, s, k) as dna, translate(substr(seq, s, k), 'T', 'U') as rna, {RCR("translate(substr(seq, s, k), 'T', 'U')")} as guide from targets, (select unnest([23, 24]) as k), range(1, 257) t(s) where s <= length(seq) - k + 1)"""


def _windows(spark, d):
    return C.enumerate_windows(targets(spark, d), [23, 24])


@query("enumerate_windows", f"with {WIN} select target, window_id, cast(length as bigint) as length, start, e as end, dna, rna, guide from win")
def enumerate_windows(spark, d):
    return tidy(_windows(spark, d))


@query("annotate_intervals", f"with {WIN}, {IV} select window_id, coalesce(label, 'unannotated') as start_label from win left join iv on start between istart and iend")
def annotate_intervals(spark, d):
    return J.range_join(_windows(spark, d), intervals(spark), "start", "istart", "iend", "label", (), "unannotated").select("window_id", F.col("label").alias("start_label"))


@query("overlap_labels", f"""with {WIN}, {IV}, cov as (select * from iv union all select 1, 10, 'unannotated' union all select 151, 170, 'unannotated' union all select 241, 256, 'unannotated'),
 h as (select window_id, string_agg(label, ';' order by istart) as labels, count(*) > 1 as crosses_boundary from win join cov on istart <= e and iend >= start group by 1) select * from h""")
def overlap_labels(spark, d):
    return C.annotate(_windows(spark, d), intervals(spark), 256).select("window_id", "labels", "crosses_boundary")


def _dg(s: str, k: int) -> str:
    table = "MAP {" + ", ".join(f"'{a}': {v}" for a, v in S.STACK_DG.items()) + "}"
    stacks = " + ".join(f"({table})[substr({s}, {i}, 2)]" for i in range(1, k))
    end = f"case when substr({s}, 1, 1) in ('A', 'U') then case when substr({s}, 2, 1) in ('A', 'U') then 0.22 else 0.44 end else 0.0 end"
    return f"cast({stacks} + {end} as double)"


@query("terminal_stability", f"with {WIN} select window_id, " + ", ".join(f"round({_dg(s, k)}, 8) as {n}_dg{k}" for k in (4, 5) for s, n in (("guide", "guide"), ("rna", "passenger"))) + " from win")
def terminal_stability(spark, d):
    return tidy(C.stability(_windows(spark, d)).select("window_id", "guide_dg4", "passenger_dg4", "guide_dg5", "passenger_dg5"))


@query("asymmetry", f"with {WIN} select target, cast(length as bigint) as length, " + ", ".join(f"round(avg({_dg('guide', k)} - {_dg('rna', k)}), 6) as asymmetry{k}" for k in (4, 5)) + " from win group by all")
def asymmetry(spark, d):
    return tidy(C.stability(_windows(spark, d)).groupBy("target", "length").agg(F.avg("asymmetry4").alias("asymmetry4"), F.avg("asymmetry5").alias("asymmetry5")), 6)


@query("band_lookup", f"with {WIN} select window_id, round(e / 1000 + length / 10000, 8) as p_whole, round((e - 1) / 1000 + 7 / 10000, 8) as p_seed from win")
def band_lookup(spark, d):
    band = spark.range(1, 257).select(F.col("id").cast("int").alias("end"), F.explode(F.sequence(F.lit(1), F.lit(24))).alias("length")).withColumn("p", F.col("end") / 1000.0 + F.col("length") / 10000.0)
    w = J.band_lookup(_windows(spark, d), band, F.col("start"), F.col("end"), "p_whole")
    return tidy(J.band_lookup(w, band, F.col("end") - 7, F.col("end") - 1, "p_seed").select("window_id", "p_whole", "p_seed"))


@query("onehot_features", f"""with {LETTERED} select id, """ + ", ".join(f"cast(substr(seq, {p}, 1) = '{v}' as int)::double as {n}_{v}" for n, p in (("p1", "1"), ("p2", "2"), ("q2", "length(seq) - 1"), ("q1", "length(seq)")) for v in "CGT")
    + """, cast(substr(seq, length(seq) - 2, 1) = 'A' as bigint) as "A3p3", cast(substr(seq, 17, 1) in ('A', 'T', 'U') as bigint) as "W17", cast(substr(seq, 10, 1) in ('A', 'G') as bigint) as "R10",
 round(length(regexp_replace(substr(seq, length(seq) - 9, 6), '[^GC]', '', 'g')) / 6.0, 8) as gc_central from lettered""")
def onehot_features(spark, d):
    r = lettered(spark, d)
    t = S.terminal_letters("sequence")
    hot = {}
    for n, k in (("p1", "5p1"), ("p2", "5p2"), ("q2", "3p2"), ("q1", "3p1")):
        hot |= S.one_hot(t[k], list("ACGT"), "A", n)
    g = S.guide_indicators("sequence")
    return tidy(r.select("id", *[c.alias(n) for n, c in hot.items()], *[g[n].alias(n) for n in ("A3p3", "W17", "R10", "gc_central")]))


XS = ["x1", "x2"]
REG = f"""{LETTERED}, reg as (select sample, unit, grp, id, y, cast(substr(seq, 1, 1) = 'A' as int)::double as x1, discount as x2 from lettered where length = 24),
 sz as (select sample, unit, count(*) as r from reg group by all), raw as (select *, 1.0::double / (count(*) over (partition by sample) * r) as raw from sz),
 sw as (select sample, unit, (select sum(r) from raw) * raw / (select sum(raw * r) from raw) as weight from raw),
 wr as (select * from reg join sw using (sample, unit)),
 mn as (select sample, unit, sum(weight * y) / sum(weight) as my, sum(weight * x1) / sum(weight) as m1, sum(weight * x2) / sum(weight) as m2 from wr group by all),
 ct as (select wr.*, y - my as y_c, x1 - m1 as x1_c, x2 - m2 as x2_c from wr join mn using (sample, unit)),
 mo as (select sum(weight * x1_c * x1_c) as a, sum(weight * x1_c * x2_c) as b, sum(weight * x2_c * x2_c) as c, sum(weight * x1_c * y_c) as p, sum(weight * x2_c * y_c) as q from ct)"""


def _reg(spark, d):
    return lettered(spark, d).filter("length = 24").select("sample", "unit", "grp", "id", "count", "y", (F.substring("sequence", 1, 1) == "A").cast("double").alias("x1"), F.col("discount").alias("x2"))


@query("sample_weights", f"with {REG} select sample, unit, round(weight, 8) as weight, count(*) as n from wr group by all")
def sample_weights(spark, d):
    return tidy(G.sample_weights(_reg(spark, d), "sample", "unit").groupBy("sample", "unit", F.round("weight", 8).alias("weight")).agg(F.count(F.lit(1)).alias("n")))


@query("group_centred", f"with {REG} select id, round(y_c, 6) as y_c, round(x1_c, 6) as x1_c, round(x2_c, 6) as x2_c from ct")
def group_centred(spark, d):
    w = G.sample_weights(_reg(spark, d), "sample", "unit")
    return tidy(G.centre(w, ["sample", "unit"], ["y", *XS], "weight").select("id", "y_c", "x1_c", "x2_c"), 6)


@query("wls_two_feature", f"with {REG} select 'x1' as feature, round((c * p - b * q) / (a * c - b * b), 6) as coefficient from mo union all select 'x2', round((a * q - b * p) / (a * c - b * b), 6) from mo")
def wls_two_feature(spark, d):
    fit = G.fit(_reg(spark, d), "y", XS, "sample", "unit")
    return spark.createDataFrame([(k, round(v, 6)) for k, v in fit.items()], "feature string, coefficient double")


def _wide(spark, d):
    t = S.terminal_letters("sequence")
    hot = {}
    for n, k in (("p1", "5p1"), ("p2", "5p2"), ("q2", "3p2"), ("q1", "3p1")):
        hot |= S.one_hot(t[k], list("ACGT"), "A", n)
    g = S.guide_indicators("sequence")
    names = [*hot, "A3p3", "W17", "R10", "gc_central"]
    r = lettered(spark, d).select("sample", "unit", "grp", "id", "y", "count", *[c.alias(n) for n, c in hot.items()], *[g[n].cast("double").alias(n) for n in ("A3p3", "W17", "R10", "gc_central")])
    return r, names


@query("wls_full")
def wls_full(spark, d):
    r, names = _wide(spark, d)
    fit = G.fit(r, "y", names, "sample", "unit")
    return spark.createDataFrame(list(fit.items()), "feature string, coefficient double")


@query("logo_cv_metrics")
def logo_cv_metrics(spark, d):
    r, names = _wide(spark, d)
    return G.leave_one_group_out(r, "y", names, "sample", "unit", "grp")


@query("coefficient_stability")
def coefficient_stability(spark, d):
    r, names = _wide(spark, d)
    return G.coefficient_stability(G.leave_one_group_out(r, "y", names, "sample", "unit", "grp"))


FOLD = f"""{REG}, regc as (select sample, unit, grp, id, y, cnt, cast(substr(seq, 1, 1) = 'A' as int)::double as x1, discount as x2 from lettered where length = 24),
 fo as (select distinct grp as held_out from reg), fw as (select held_out, reg.*, raw.raw as w from fo join reg on grp <> held_out join raw using (sample, unit)),
 fm as (select held_out, sample, unit, sum(w * y) / sum(w) as my, sum(w * x1) / sum(w) as m1, sum(w * x2) / sum(w) as m2 from fw group by all),
 fc as (select held_out, w, y - my as yc, x1 - m1 as a1, x2 - m2 as a2 from fw join fm using (held_out, sample, unit)),
 fs as (select held_out, sum(w * a1 * a1) as a, sum(w * a1 * a2) as b, sum(w * a2 * a2) as c, sum(w * a1 * yc) as p, sum(w * a2 * yc) as q from fc group by 1),
 co as (select held_out, (c * p - b * q) / (a * c - b * b) as b1, (a * q - b * p) / (a * c - b * b) as b2 from fs),
 hs as (select regc.*, round(b1 * x1 + b2 * x2, 6) as score from regc join co on grp = held_out),
 hr as (select *, rank() over (w order by score) + (count(*) over (partition by grp, sample, unit, score) - 1) / 2.0 as rx, rank() over (w order by cnt) + (count(*) over (partition by grp, sample, unit, cnt) - 1) / 2.0 as ry,
  row_number() over (w order by score desc, id) <= ceil(0.1 * count(*) over w) as t from hs window w as (partition by grp, sample, unit)),
 hm as (select grp, sample, unit, count(*) as n, count(*) filter (cnt > 0) as n_represented, cast(sum(cnt) as bigint) as amount, case when count(*) >= 2 and var_pop(rx) > 0 and var_pop(ry) > 0 then corr(rx, ry) end as rho,
  sum(cnt) filter (t) / sum(cnt) as top_share, (sum(cnt) filter (t) / sum(cnt)) / (count(*) filter (t) / count(*)) as lift from hr group by all),
 hf as (select grp, sum(n) as n, sum(n_represented) as n_represented, sum(amount) as amount, median(rho) as rho, median(lift) as lift from hm group by 1)"""


def _two_fold(spark, d):
    return G.leave_one_group_out(_reg(spark, d), "y", XS, "sample", "unit", "grp")


def _held_out(spark, d):
    rows = _reg(spark, d)
    scored = G.held_out_scores(rows, _two_fold(spark, d), XS, "grp").withColumn("score", F.round("score", 6))
    return G.held_out_metrics(scored, ["grp", "sample", "unit"], "score", "count", "id")


@query("logo_two_feature", f"with {FOLD} select held_out, 'x1' as feature, round(b1, 6) as coefficient from co union all select held_out, 'x2', round(b2, 6) from co")
def logo_two_feature(spark, d):
    return tidy(_two_fold(spark, d), 6)


@query("held_out_metrics", f"with {FOLD} select grp, sample, unit, n, n_represented, amount, round(rho, 6) as rho, round(top_share, 6) as top_share, round(lift, 6) as lift from hm")
def held_out_metrics(spark, d):
    return tidy(_held_out(spark, d), 6)


@query("held_out_folds", f"with {FOLD} select grp, cast(n as bigint) as n, cast(n_represented as bigint) as n_represented, cast(amount as bigint) as amount, round(rho, 6) as rho, round(lift, 6) as lift from hf")
def held_out_folds(spark, d):
    return tidy(G.fold_summary(_held_out(spark, d), "grp"), 6)


@query("held_out_summary", f"""with {FOLD} select count(*) as n_folds, round(median(rho), 6) as rho_median, round(min(rho), 6) as rho_low, round(max(rho), 6) as rho_high, count(rho) as rho_valid, count(*) filter (round(rho, 9) > 0) as rho_favourable,
 round(median(lift), 6) as lift_median, round(min(lift), 6) as lift_low, round(max(lift), 6) as lift_high, count(lift) as lift_valid, count(*) filter (round(lift, 9) > 1) as lift_favourable from hf""")
def held_out_summary(spark, d):
    folds = G.fold_summary(_held_out(spark, d), "grp").withColumns({m: F.round(m, 9) for m in ("rho", "lift")})
    return tidy(G.cross_summary(folds), 6)


@query("coefficient_stability_two", f"""with {FOLD}, l as (select 'x1' as feature, b1 as v from co union all select 'x2', b2 from co) select feature, round(median(v), 6) as median, round(min(v), 6) as low, round(max(v), 6) as high, count(*) as n_folds,
 count(*) filter (v > 0) in (0, count(*)) as same_sign from l group by 1""")
def coefficient_stability_two(spark, d):
    return tidy(G.coefficient_stability(_two_fold(spark, d)), 6)


@query("top10_lift", f"""with {LETTERED}, o as (select *, row_number() over (partition by sample order by y desc, id) <= ceil(0.1 * count(*) over (partition by sample)) as t from lettered)
 select sample, cast(sum(cnt) filter (t) as bigint) as top_amount, cast(sum(cnt) as bigint) as amount, count(*) filter (t) as n_top, count(*) as n, round(sum(cnt) filter (t) / sum(cnt), 8) as top_share,
 round((sum(cnt) filter (t) / sum(cnt)) / (count(*) filter (t) / count(*)), 8) as lift from o group by 1""")
def top10_lift(spark, d):
    return tidy(R.top_share_and_lift(lettered(spark, d), ["sample"], "y", "id", "count", 0.1))


def _pct(v: str, o: str = "") -> str:
    return f"(rank() over (partition by stratum order by {v}{o}) + (count(*) over (partition by stratum, {v}) - 1) / 2.0 - 0.5) / count(*) over (partition by stratum)"


LAY = f"""{PARTS}, lay as (select *, {_pct("m1")} as m1_pct, {_pct("m2")} as m2_pct, {_pct("m3")} as m3_pct from parts),
 intg as (select *, round((m1_pct + m2_pct + m3_pct) / 3.0, 12) as score, least(m1_pct, m2_pct, m3_pct) as weakest from lay)"""
METRICS = ["m1", "m2", "m3"]
PCT = [f"{m}_pct" for m in METRICS]


def _layers(spark, d):
    return C.layer_scores(parts(spark, d), ["stratum"], METRICS)


@query("favourable_percentile", f"with {LAY} select stratum, id, round(m2_pct, 8) as pct, round(1 - m2_pct, 8) as pct_desc from lay")
def favourable_percentile(spark, d):
    p = R.favourable_percentile(parts(spark, d), ["stratum"], "m2", "pct")
    return tidy(R.favourable_percentile(p, ["stratum"], "m2", "pct_desc", descending=True).select("stratum", "id", "pct", "pct_desc"))


@query("layer_scores", f"with {LAY} select stratum, id, " + ", ".join(f"round({p}, 8) as {p}" for p in PCT) + " from lay")
def layer_scores(spark, d):
    return tidy(_layers(spark, d).select("stratum", "id", *PCT))


@query("weight_grid", f"with {LAY} select stratum, cast(step as bigint) as step, round(avg(step / 10 * m1_pct + (1 - step / 10) * m2_pct), 8) as mean_score, round(max(step / 10 * m1_pct + (1 - step / 10) * m2_pct), 8) as best from lay, range(0, 11) t(step) group by all")
def weight_grid(spark, d):
    g = C.weight_grid(_layers(spark, d), "m1_pct", "m2_pct")
    return tidy(g.groupBy("stratum", "step").agg(F.avg("score").alias("mean_score"), F.max("score").alias("best")))


@query("layer_spearman", f"with {LAY} " + " union all ".join(f"select stratum, round(corr(m{a}_pct, m{b}_pct), 8) as rho, count(*) as n, 'm{a}_pct' as layer_a, 'm{b}_pct' as layer_b from lay group by 1" for a, b in ((1, 2), (1, 3), (2, 3))))
def layer_spearman(spark, d):
    return tidy(C.layer_agreement(_layers(spark, d), ["stratum"], PCT))


@query("three_way_join", f"with {LAY} select id, stratum, round(m1_pct, 8) as m1_pct, round(m2_pct, 8) as m2_pct, round(m3_pct, 8) as m3_pct from lay")
def three_way_join(spark, d):
    lay = _layers(spark, d)
    frames = [lay.select("id", "stratum", p) for p in PCT]
    return tidy(J.one_to_one(frames, "id", ["stratum"]))


@query("equal_layer_rank", f"""with {LAY} select stratum, id, round(score, 8) as score, round(weakest, 8) as weakest, rank() over (partition by stratum order by score desc) + (count(*) over (partition by stratum, score) - 1) / 2.0 as rank, round({_pct("score")}, 8) as percentile from intg""")
def equal_layer_rank(spark, d):
    lay = _layers(spark, d).withColumn("score", F.round((F.col("m1_pct") + F.col("m2_pct") + F.col("m3_pct")) / F.lit(3.0), 12)).withColumn("weakest", F.least(*PCT))
    r = R.favourable_percentile(R.average_rank(lay, ["stratum"], "score", "rank", True), ["stratum"], "score", "percentile")
    return tidy(r.select("stratum", "id", "score", "weakest", "rank", "percentile"))


FRONT = f"""{LAY}, dom as (select a.id as w, b.id as l from lay a join lay b using (stratum) where a.m1 >= b.m1 and a.m2 >= b.m2 and a.m3 >= b.m3 and (a.m1 > b.m1 or a.m2 > b.m2 or a.m3 > b.m3)),
 ch(id, depth) as (select id, 1 from lay union select d.l, ch.depth + 1 from ch join dom d on d.w = ch.id), fr as (select stratum, id, max(depth) as front from ch join lay using (id) group by all)"""


@query("pareto_front", f"with recursive {FRONT} select stratum, id, cast(front as bigint) as front from fr")
def pareto_front(spark, d):
    return P.pareto_fronts(parts(spark, d), ["stratum"], "id", METRICS).select("stratum", "id", "front")


@query("pareto_histogram", f"with recursive {FRONT} select stratum, cast(front as bigint) as front, count(*) as n from fr group by all")
def pareto_histogram(spark, d):
    return P.front_histogram(P.pareto_fronts(parts(spark, d), ["stratum"], "id", METRICS), ["stratum"])


@query("dominance_counts", f"with recursive {FRONT} select w as winner, count(*) as n from dom group by 1")
def dominance_counts(spark, d):
    return P.dominance_count(parts(spark, d), ["stratum"], "id", METRICS).select(F.col("id").alias("winner"), "n")


REGION = f"""{LAY}, pos as (select *, row_number() over (partition by stratum order by id) as start from lay),
 sl as (select stratum, start, avg(m1_pct) over f as m1_mean, avg(m2_pct) over f as m2_mean, count(*) over f as n from pos window f as (partition by stratum order by start rows between current row and 4 following)),
 rg as (select * from sl where n = 5)"""


def _regions(spark, d):
    pos = _layers(spark, d).withColumn("start", F.row_number().over(W.partitionBy("stratum").orderBy("id")))
    return C.regions(pos, ["stratum"], "start", ["m1_pct", "m2_pct"], 23, 27)


@query("region_sliding_mean", f"with {REGION} select stratum, start, round(m1_mean, 8) as m1_pct_mean, round(m2_mean, 8) as m2_pct_mean from rg")
def region_sliding_mean(spark, d):
    return tidy(_regions(spark, d).select("stratum", "start", "m1_pct_mean", "m2_pct_mean"))


@query("top_bottom_by_feature", f"""with {REGION}, v as (select stratum, start, round(m2_mean, 9) as s from rg),
 r as (select stratum, 'top' as side, row_number() over (partition by stratum order by s desc, start) as place, start, s from v union all select stratum, 'bottom', row_number() over (partition by stratum order by s, start), start, s from v),
 g as (select stratum, side, place from (select distinct stratum from v), (select unnest(['top', 'bottom']) as side), range(1, 6) t(place))
 select stratum, side, cast(place as bigint) as place, start, round(s, 8) as score from g left join r using (stratum, side, place)""")
def top_bottom_by_feature(spark, d):
    v = _regions(spark, d).select("stratum", "start", F.round("m2_pct_mean", 9).alias("score"))
    return tidy(R.top_bottom_padded(v, "stratum", "score", "start", 5).select("stratum", "side", "place", "start", "score"))


SETS = [("local", 80, 40), ("wide", 300, 150)]
#: p of a band, by set, end and length; lengths above 23 are missing.
BAND = {"local": 1000.0, "wide": 2000.0}


@query("accessibility", f"""with {WIN} select target, window_id, cast(length as bigint) as length, {", ".join(f"case when length <= 23 then round(e / {v} + length / 10000, 8) end as {n}_whole, round((e - 1) / {v} + 7 / 10000, 8) as {n}_seed" for n, v in BAND.items())} from win""")
def accessibility(spark, d):
    t = targets(spark, d).select("target", F.explode(F.sequence(F.lit(1), F.length("sequence"))).alias("end"))
    band = t.withColumn("length", F.explode(F.sequence(F.lit(1), F.lit(23)))).withColumn("set", F.explode(F.array(*[F.lit(n) for n in BAND])))
    band = band.withColumn("p", F.col("end") / F.when(F.col("set") == "local", BAND["local"]).otherwise(BAND["wide"]) + F.col("length") / 10000)
    found = C.accessibility(_windows(spark, d), band, list(BAND))
    return tidy(found.select("target", "window_id", "length", *[f"{n}_{part}" for n in BAND for part in ("whole", "seed")]))


@query("fold_runs", f"""with {WIN}, t as (select target, 24 as interval, 256 as n from win group by 1), s as (select * from (values {", ".join(map(str, SETS))}) v("set", w, span))
 select target, cast(interval as bigint) as interval, "set", cast(w as bigint) as window, cast(span as bigint) as span, cast(least(w, n) as bigint) as effective_window, cast(least(span, least(w, n) - 1) as bigint) as effective_span from t, s""")
def fold_runs(spark, d):
    return tidy(C.fold_runs(_windows(spark, d), targets(spark, d).withColumn("target_length", F.length("sequence")), SETS))

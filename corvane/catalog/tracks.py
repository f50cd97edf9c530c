"""Queries of tracks, anchors, flanks, lags and permutation nulls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import shifts as S
from ..operators import statistics as T
from ..operators import windows as X
from ..plans import tracks as K
from ..streaming.windows import run_once, tumbling_counts
from .roles import BIN, KINDS, N_BINS, TRACK, events, query, table, tidy

KEYS = ["contig"]


def _track(spark, d):
    e = events(spark, d).withColumn("one", F.lit(1.0))
    return K.dense_track(K.binned(e, KEYS, "minute", "kind", "one", BIN, KINDS), KEYS, N_BINS, KINDS)


def _scored(spark, d):
    return _track(spark, d).withColumn("balanced", F.sqrt(F.col("click") * F.col("view"))).withColumn("combined", F.col("click") + F.col("view"))


def _anchors(spark, d):
    return X.spaced_selection(_scored(spark, d), KEYS, "bin", "combined", 5)


ANCHOR = f"""{TRACK}, sc as (select *, sqrt(click * view) as balanced, click + view as combined from track),
 th as (select contig, quantile_cont(combined, 0.9) filter (combined > 0) as threshold, count(*) filter (combined > 0) as n_positive from sc group by 1),
 cand as (select contig, bin, combined, row_number() over (partition by contig order by combined desc, bin) as rn from sc join th using (contig) where combined > 0 and combined >= threshold and n_positive >= 3),
 greedy(contig, rn, kept) as (select distinct contig, cast(0 as bigint), cast([] as bigint[]) from cand union all
  select g.contig, c.rn, case when len(list_filter(g.kept, lambda x: abs(x - c.bin) <= 5)) = 0 then list_append(g.kept, c.bin) else g.kept end from greedy g join cand c on c.contig = g.contig and c.rn = g.rn + 1),
 fin as (select contig, arg_max(kept, rn) as kept from greedy group by 1), anc as (select contig, unnest(kept) as bin from fin where len(kept) >= 3),
 fl as (select a.contig, o > 0 as down, t.* exclude (contig) from anc a, range(-10, 11) r(o) join track t on t.contig = a.contig and t.bin = a.bin + o where o <> 0),
 fm as (select contig, """ + ", ".join(f"avg({k}) filter ({n} down) as {k}_{s}" for k in KINDS for s, n in (("up", "not"), ("down", ""))) + " from fl group by 1)"


@query("fractional_weights", """with l as (select distinct l_orderkey as read_name, l_partkey % 20 as contig, cast(l_quantity as bigint) as start from lineitem),
 r as (select o_orderkey as read_name, o_orderstatus as unit, o_orderpriority as strand, o_custkey % 50 as sequence, cast(o_totalprice as bigint) as count from orders),
 n as (select *, count(*) over (partition by read_name) as k from l join r using (read_name)), u as (select distinct unit, strand, sequence, contig, start from n),
 w as (select contig, 'abundance' as mode, count / k as w from n union all select contig, 'unique_sequence', 1.0 / count(*) over (partition by unit, strand, sequence) from u)
 select contig, mode, round(sum(w), 4) as weight, count(*) as n from w group by all""")
def fractional_weights(spark, d):
    loci = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("read_name"), (F.col("l_partkey") % 20).alias("contig"), F.col("l_quantity").cast("bigint").alias("start"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("read_name"), F.col("o_orderstatus").alias("unit"), F.col("o_orderpriority").alias("strand"), F.lit(1).alias("length"), (F.col("o_custkey") % 50).alias("sequence"), F.round("o_totalprice", 0).cast("bigint").alias("count"))
    w = K.fractional_loci(loci, o)
    return tidy(w.groupBy("contig", "mode").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n")), 4)


@query("binned_tracks", f"with {TRACK} select contig, bin, " + ", ".join(KINDS) + " from track")
def binned_tracks(spark, d):
    return tidy(_track(spark, d))


@query("anchor_scores", f"with recursive {ANCHOR} select contig, bin, round(balanced, 8) as balanced, combined from sc where combined > 0")
def anchor_scores(spark, d):
    return tidy(_scored(spark, d).filter("combined > 0").select("contig", "bin", "balanced", "combined"))


@query("anchor_threshold", f"with recursive {ANCHOR} select contig, round(threshold, 8) as threshold, n_positive from th")
def anchor_threshold(spark, d):
    pos = F.when(F.col("combined") > 0, F.col("combined"))
    return tidy(_scored(spark, d).groupBy("contig").agg(F.percentile(pos, 0.9).alias("threshold"), F.count(pos).alias("n_positive")))


@query("anchor_select", f"with recursive {ANCHOR} select contig, bin from anc")
def anchor_select(spark, d):
    return _anchors(spark, d).select("contig", "bin")


@query("window_means", f"""with recursive {ANCHOR} select contig, case when down then 'down' else 'up' end as side, sum(view) as total, count(*) as n, round(sum(view) / count(*), 8) as mean from fl group by all""")
def window_means(spark, d):
    return tidy(J.window_means(_track(spark, d).select("contig", "bin", "view"), _anchors(spark, d), KEYS, "bin", "view", 10))


D = lambda k: f"({k}_down - {k}_up) / nullif({k}_down + {k}_up, 0)"


@query("directionality", f"""with recursive {ANCHOR} select contig, round({D("view")}, 8) as d_target, round({D("click")}, 8) as d_control, round({D("view")} - {D("click")}, 8) as specific,
 round(view_down / nullif(purchase_down + view_down, 0), 8) as share_down, round(view_up / nullif(purchase_up + view_up, 0), 8) as share_up, round(view_down / nullif(purchase_down + view_down, 0) - view_up / nullif(purchase_up + view_up, 0), 8) as share_delta from fm""")
def directionality(spark, d):
    m = K.flank_means(_track(spark, d), _anchors(spark, d), KEYS, KINDS, 10)
    return tidy(K.endpoints(m, "view", "click", "purchase").select("contig", "d_target", "d_control", "specific", "share_down", "share_up", "share_delta"))


LAGS = list(range(-20, 21, 5))


@query("lag_correlation", f"""with {TRACK}, p as (select a.contig, lag, a.click as x, b.view as y from track a, (select unnest({LAGS}) as lag) join track b on b.contig = a.contig and b.bin = a.bin + lag)
 select contig, cast(lag as bigint) as lag, round(case when count(*) >= 10 and var_pop(x) > 0 and var_pop(y) > 0 then corr(x, y) end, 8) as r, count(*) as n from p group by all""")
def lag_correlation(spark, d):
    return tidy(T.lag_correlation(_track(spark, d), KEYS, "bin", "click", "view", LAGS))


LOG_LAGS = list(range(-50, 51))
LOGLAG = f"""{TRACK}, p as (select a.contig, lag, ln(1 + a.click) as x, ln(1 + b.view) as y from track a, (select unnest({LOG_LAGS}) as lag) join track b on b.contig = a.contig and b.bin = a.bin + lag),
 lr as (select contig, lag, case when count(*) >= 10 and var_pop(x) > 0 and var_pop(y) > 0 then corr(x, y) end as r, count(*) as n from p group by all)"""


def _log_lags(spark, d):
    logged = _track(spark, d).withColumns({k: F.log1p(k) for k in ("click", "view")})
    return T.lag_correlation(logged, KEYS, "bin", "click", "view", LOG_LAGS)


@query("lag_correlation_log1p", f"with {LOGLAG} select contig, cast(lag as bigint) as lag, round(r, 8) as r, n from lr")
def lag_correlation_log1p(spark, d):
    return tidy(_log_lags(spark, d))


@query("lag_asymmetry", f"with {LOGLAG} select contig, round(avg(r) filter (lag > 0) - avg(r) filter (lag < 0), 8) as asymmetry from lr group by 1")
def lag_asymmetry(spark, d):
    return tidy(T.lag_asymmetry(_log_lags(spark, d), KEYS))


@query("circular_shift", f"with {TRACK} select contig, (bin + 37) % {N_BINS} as bin, view from track where view > 0")
def circular_shift(spark, d):
    t = X.circular_shift(_track(spark, d), "bin", F.lit(N_BINS), F.lit(37), "bin")
    return t.filter("view > 0").select("contig", F.col("bin").cast("bigint").alias("bin"), "view")


@query("allowed_shifts", f"""with {TRACK}, n as (select contig, cast(count(*) as bigint) as n from track where view > 0 group by 1)
 select contig, n, cast(s as bigint) as shift from n, range(1, 720) t(s) where s < n and (least(s, n - s) > 50 or n <= 101)""")
def allowed_shifts(spark, d):
    n = _track(spark, d).filter("view > 0").groupBy("contig").agg(F.count(F.lit(1)).alias("n"))
    return tidy(n.select("contig", "n", F.explode(X.allowed_shifts(F.col("n"), 50)).alias("shift")))


REPLICATES, EXCLUSION, SEED, FLANK = 5000, 20, 20260810, 10
#: Digest draws, then window sums of the rolled track for every distinct shift.
SHIFTED = f"""{ANCHOR}, dr as (select contig, r as replicate, {EXCLUSION + 1} + cast('0x' || substr(md5('{SEED}|' || contig || '|' || r), 1, 8) as bigint) % {N_BINS - 1 - 2 * EXCLUSION} as shift from (select distinct contig from track), range(0, {REPLICATES}) t(r)),
 ws as (select s.contig, s.shift, o > 0 as down, sum(view) as view, sum(click) as click, count(*) as c from (select distinct contig, shift from dr) s join anc a using (contig), range(-{FLANK}, {FLANK + 1}) r(o) join track t
  on t.contig = a.contig and t.bin = (a.bin + o - s.shift + {N_BINS}) % {N_BINS} where o <> 0 and a.bin + o between 0 and {N_BINS - 1} group by all),
 ms as (select contig, shift, """ + ", ".join(f"sum({k}) filter ({n} down) / sum(c) filter ({n} down) as {k}_{side}" for k in ("view", "click") for side, n in (("up", "not"), ("down", ""))) + """ from ws group by all),
 nu as (select contig, replicate, shift, """ + ", ".join(f"({k}_down - {k}_up) / nullif({k}_down + {k}_up, 0) as {k}" for k in ("view", "click")) + """ from dr join ms using (contig, shift)),
 ob as (select contig, (view_down - view_up) / nullif(view_down + view_up, 0) as obs from fm),
 ex as (select contig, obs, count(*) filter (view >= obs) as n_exceed, count(view) as n_null from ob left join nu using (contig) group by all),
 pv as (select *, case when obs is not null and n_null > 0 then (n_exceed + 1) / (n_null + 1) end as p from ex)"""


def _shift_null(spark, d):
    return S.shift_null(_track(spark, d), KEYS, "bin", ["view", "click"], _anchors(spark, d), FLANK, REPLICATES, EXCLUSION, SEED)


def _observed(spark, d):
    m = K.flank_means(_track(spark, d), _anchors(spark, d), KEYS, KINDS, FLANK)
    return K.endpoints(m, "view", "click", "purchase").select("contig", F.col("d_target").alias("view"))


@query("shift_null", f"with recursive {SHIFTED} select contig, cast(replicate as int) as replicate, cast(shift as bigint) as shift, round(view, 8) as view, round(click, 8) as click from nu")
def shift_null(spark, d):
    return tidy(_shift_null(spark, d).select("contig", "replicate", "shift", "view", "click"))


@query("permutation_p", f"with recursive {SHIFTED} select contig, round(obs, 8) as obs, n_exceed, n_null, round(p, 8) as p from pv")
def permutation_p(spark, d):
    obs = _observed(spark, d).withColumnRenamed("view", "obs")
    return tidy(T.empirical_p(_shift_null(spark, d).select("contig", F.col("view").alias("v")), obs, KEYS, "v", "obs").select("contig", "obs", "n_exceed", "n_null", "p"))


@query("null_chain", f"""with recursive {SHIFTED}, rk as (select *, row_number() over (order by p, contig) as i, count(*) over () as m from pv where obs is not null)
 select contig, round(obs, 8) as estimate, cast(1 as bigint) as n_rows, n_exceed, n_null, round(p, 8) as p, round(least(1, min(p * m / i) over (order by i desc)), 8) as q from rk""")
def null_chain(spark, d):
    """Anchors, their shift null and the corrected results in one: every contig's balanced estimate against its own nulls."""
    r = T.null_results(_observed(spark, d), _shift_null(spark, d), KEYS, "replicate", "view")
    return tidy(r.select("contig", "estimate", "n_rows", "n_exceed", "n_null", "p", "q"))


@query("event_windows", "select date_trunc('hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 6) as total from events group by all")
def event_windows(spark, d):
    return tumbling_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "value").withColumn("total", F.round("total", 6))


@query("event_windows_streamed", "select date_trunc('hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 6) as total from events group by all")
def event_windows_streamed(spark, d):
    schema = table(spark, d, "events").schema
    return run_once(spark, d, "events.parquet", schema, lambda s: tumbling_counts(s.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "value")).withColumn("total", F.round("total", 6))

"""Queries of terminal and positional letters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import joins as J
from ..operators import statistics as T
from ..plans import candidates as C
from ..plans import letters as P
from .roles import BACKGROUND, LETTERED, background, lettered, query, table, tidy

CELL = "sample, unit, length, strand"
RC = lambda s: f"reverse(translate({s}, 'ACGT', 'TGCA'))"


def _chain(terminal: bool) -> str:
    """Observed, expected and enrichment relations, by terminal or by position."""
    pos = (lambda s: f"(select unnest(['5p1', '5p2', '3p2', '3p1']) as position, unnest([substr({s}, 1, 1), substr({s}, 2, 1), substr({s}, length({s}) - 1, 1), substr({s}, length({s}), 1)]) as letter)") if terminal else (
        lambda s: f"(select p as position, substr({s}, p, 1) as letter from range(1, length({s}) + 1) t(p))"
    )
    every = "(select unnest(['5p1', '5p2', '3p2', '3p1']) as position)" if terminal else "(select cast(p as bigint) as position from range(1, 25) t(p))"
    return f"""{LETTERED}, {BACKGROUND},
 dist as (select {CELL}, seq, sum(cnt) as cnt from lettered group by all),
 cnt0 as (select {CELL}, position, letter, sum(cnt) as abundance, count(*) as unique_sequence from dist, lateral {pos("dist.seq")} group by all),
 cnt as (select * from cnt0{" union all select sample, unit, length, 'combined', position, letter, sum(abundance), sum(unique_sequence) from cnt0 group by all" if terminal else ""}),
 grid as (select {CELL}, position, letter from (select distinct {CELL} from cnt), {every}, (select unnest(['A', 'C', 'G', 'T']) as letter)),
 dense as (select grid.*, coalesce(abundance, 0) as a, coalesce(unique_sequence, 0) as u from grid left join cnt using ({CELL}, position, letter)),
 long as (select {CELL}, position, letter, 'abundance' as mode, a as n from dense union all select {CELL}, position, letter, 'unique_sequence', u from dense),
 obs as (select *, n / nullif(sum(n) over w, 0) as fraction, sum(n) over w as total from long window w as (partition by {CELL}, mode, position)),
 win as (select sample, unit, k as length, record, s as start, substr(seq, s, k) as w from background, (select unnest([23, 24]) as k), range(1, 65) t(s) where s <= length(seq) - k + 1),
 stranded as (select sample, unit, length, 'sense' as strand, w from win where w not like '%N%' union all select sample, unit, length, 'antisense', {RC("w")} from win where w not like '%N%'),
 ecnt as (select {CELL}, position, letter, count(*) as n from stranded, lateral {pos("stranded.w")} group by all),
 egrid as (select {CELL}, position, letter from (select distinct {CELL} from stranded), {every}, (select unnest(['A', 'C', 'G', 'T']) as letter)),
 exp0 as (select egrid.*, coalesce(n, 0) as n from egrid left join ecnt using ({CELL}, position, letter)),
 exp as (select * from (select *, n / nullif(sum(n) over w, 0) as expected, sum(n) over w as windows from exp0 window w as (partition by {CELL}, position)) where windows > 0)"""


TERM, POSI = _chain(True), _chain(False)
TERM += """,
 tot as (select sample, unit, length, mode, position, coalesce(max(total) filter (strand = 'sense'), 0) as s, coalesce(max(total) filter (strand = 'antisense'), 0) as a from obs where strand <> 'combined' group by all),
 ew as (select sample, unit, length, position, letter, max(expected) filter (strand = 'sense') as es, max(expected) filter (strand = 'antisense') as ea from exp group by all),
 comb as (select sample, unit, length, mode, position, letter, s / nullif(s + a, 0) as sense_share, a / nullif(s + a, 0) as antisense_share, s / nullif(s + a, 0) * es + a / nullif(s + a, 0) * ea as expected
  from tot join ew using (sample, unit, length, position)),
 enr0 as (select obs.*, expected from obs join exp using (sample, unit, length, strand, position, letter) where strand <> 'combined'
  union all select obs.*, expected from obs join comb using (sample, unit, length, mode, position, letter) where strand = 'combined'),
 enr as (select *, case when total > 0 then fraction / nullif(expected, 0) end as ratio from enr0),
 es as (select length, strand, mode, position, letter, sample, median(ratio) as ratio, count(ratio) as n_units from enr where ratio is not null group by all),
 ed as (select length, strand, mode, position, letter, median(ratio) as ratio, count(ratio) as n_members from es group by all)"""
POSI += """,
 wide as (select sample, unit, length, strand, position, letter, max(expected) as expected, max(fraction) filter (mode = 'abundance') as abundance_fraction, max(fraction) filter (mode = 'unique_sequence') as unique_fraction,
  max(case when total > 0 then fraction / nullif(expected, 0) end) filter (mode = 'abundance') as abundance_ratio, max(case when total > 0 then fraction / nullif(expected, 0) end) filter (mode = 'unique_sequence') as unique_ratio
  from obs join exp using (sample, unit, length, strand, position, letter) group by all),
 posi as (select *, case when unique_ratio > 0 then abundance_ratio / unique_ratio end as accumulation_ratio, abundance_ratio - unique_ratio as accumulation_delta,
  case when unique_ratio > 0 and abundance_ratio > 0 then log2(abundance_ratio / unique_ratio) end as accumulation_log2 from wide),
 sm as (select length, strand, position, letter, sample, round(median(accumulation_delta), 9) as m from posi group by all),
 st0 as (select length, strand, position, letter, count(*) filter (m > 0) as n_positive, count(*) filter (m < 0) as n_negative from sm group by all),
 st as (select *, case when n_positive + n_negative > 0 then least(1.0, 2 * list_sum(list_transform(range(0, least(n_positive, n_negative) + 1),
  lambda k: cast(factorial(cast(n_positive + n_negative as int)) / (factorial(cast(k as int)) * factorial(cast(n_positive + n_negative - k as int))) as double))) / pow(2.0, n_positive + n_negative)) end as p,
  position between 3 and length - 2 as inner_position from st0),
 fam as (select *, case when inner_position then p end as p_family from st),
 fr as (select *, count(*) over (partition by length, strand, p_family is not null) as m, row_number() over (partition by length, strand, p_family is not null order by p_family, position, letter) as i from fam),
 q as (select *, case when p_family is not null then least(1.0, min(p_family * m / i) over w) end as q_bh,
  case when p_family is not null then least(1.0, min(p_family * m * list_sum(list_transform(range(1, m + 1), lambda k: 1.0::double / k)) / i) over w) end as q_by
  from fr window w as (partition by length, strand, p_family is not null order by i desc rows between unbounded preceding and current row))"""

INT = "cast(length as bigint) as length"


def _obs(spark, d):
    return P.dense_letters(P.with_combined(P.observed(P.usable(lettered(spark, d), [23, 24]))), list(S.TERMINALS), P.CELL)


def _exp(spark, d):
    return P.expected(background(spark, d), [23, 24])


def _enr(spark, d, exp=None):
    obs, exp = _obs(spark, d), _exp(spark, d) if exp is None else exp
    # some of these backgrounds are masked throughout and expect nothing
    return P.enrichment(obs, exp, P.combined_expectation(obs, exp), required=False)


def _pobs(spark, d):
    return P.dense_letters(P.observed(P.usable(lettered(spark, d), [23, 24]), terminal=False), list(range(1, 25)), P.CELL)


def _posi(spark, d):
    return P.positional(_pobs(spark, d), P.expected(background(spark, d), [23, 24], terminal=False), required=False)


def _found(spark, d):
    p = _posi(spark, d)
    s = p.groupBy("length", "strand", "position", "letter", "sample").agg(F.round(F.median("accumulation_delta"), 9).alias("accumulation_delta"))
    return P.discovery(s, "accumulation_delta")


@query("letters_observed", f"with {TERM} select sample, unit, {INT}, strand, mode, position, letter, cast(n as bigint) as n, round(fraction, 8) as fraction, cast(total as bigint) as total from obs")
def letters_observed(spark, d):
    return tidy(_obs(spark, d))


@query("letters_expected", f"with {TERM} select sample, unit, {INT}, strand, position, letter, cast(n as bigint) as n, round(expected, 8) as expected, cast(windows as bigint) as windows from exp")
def letters_expected(spark, d):
    return tidy(_exp(spark, d).withColumn("length", F.col("length").cast("bigint")))


@query("letters_combined_expectation", f"with {TERM} select sample, unit, {INT}, mode, position, letter, round(sense_share, 8) as sense_share, round(antisense_share, 8) as antisense_share, round(expected, 8) as expected from comb")
def letters_combined_expectation(spark, d):
    return tidy(P.combined_expectation(_obs(spark, d), _exp(spark, d)))


@query("letters_enrichment", f"with {TERM} select sample, unit, {INT}, strand, mode, position, letter, round(fraction, 8) as fraction, round(expected, 8) as expected, round(ratio, 8) as ratio from enr")
def letters_enrichment(spark, d):
    return tidy(_enr(spark, d).select(*P.CELL, "mode", "position", "letter", "fraction", "expected", "ratio"))


@query("enrichment_sample", f"with {TERM} select {INT}, strand, mode, position, letter, sample, round(ratio, 8) as ratio, n_units from es")
def enrichment_sample(spark, d):
    return tidy(P.enrichment_samples(_enr(spark, d)))


@query("enrichment_dataset", f"with {TERM} select {INT}, strand, mode, position, letter, round(ratio, 8) as ratio, n_members from ed")
def enrichment_dataset(spark, d):
    return tidy(P.enrichment_dataset(_enr(spark, d)))


@query("enrichment_pooled", f"""with {TERM} select {INT}, strand, position, letter, round(sum(n) / sum(total), 8) as pooled_observed, round(sum(total * expected) / sum(total), 8) as pooled_expected,
 round(sum(n) / nullif(sum(total * expected), 0), 8) as pooled_ratio from enr where mode = 'abundance' and total > 0 and expected is not null group by length, strand, position, letter""")
def enrichment_pooled(spark, d):
    return tidy(P.enrichment_pooled(_enr(spark, d)))


@query("length_compare_spearman", f"""with {TERM}, x as (select a.strand, a.mode, round(a.ratio, 9) as x, round(b.ratio, 9) as y from ed a join ed b using (strand, mode, position, letter) where a.length = 23 and b.length = 24),
 r as (select strand, mode, rank() over (partition by strand, mode order by x) + (count(*) over (partition by strand, mode, x) - 1) / 2.0 as rx, rank() over (partition by strand, mode order by y) + (count(*) over (partition by strand, mode, y) - 1) / 2.0 as ry from x)
 select strand, mode, round(corr(rx, ry), 8) as rho, count(*) as n from r group by all""")
def length_compare_spearman(spark, d):
    ed = P.enrichment_dataset(_enr(spark, d)).withColumn("ratio", F.round("ratio", 9))
    return tidy(P.length_agreement(ed, 23, 24))


@query("kmer_background_counts", f"with {TERM} select sample, unit, {INT}, count(*) as candidates, count(*) filter (w not like '%N%') as valid, count(*) filter (w like '%N%') as excluded from win group by all")
def kmer_background_counts(spark, d):
    w = P.background_windows(background(spark, d), [23, 24])
    return tidy(w.groupBy("sample", "unit", "length").agg(F.count(F.lit(1)).alias("candidates"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("excluded")))


OPP = f"{TERM}, opp as (select distinct sample, unit, length, {RC('w')} as seq from win where w not like '%N%')"


@query("kmer_distinct_opportunities", f"with {OPP} select sample, unit, {INT}, count(*) as n, min(seq) as first_sequence from opp group by all")
def kmer_distinct_opportunities(spark, d):
    u = C.training_universe(background(spark, d), lettered(spark, d), [23, 24])
    return tidy(u.groupBy("sample", "unit", "length").agg(F.count(F.lit(1)).alias("n"), F.min("sequence").alias("first_sequence")))


POS_COLS = ["expected", "abundance_fraction", "unique_fraction", "abundance_ratio", "unique_ratio"]


@query("positional_landscape", f"with {POSI} select sample, unit, {INT}, strand, cast(position as bigint) as position, letter, " + ", ".join(f"round({c}, 8) as {c}" for c in POS_COLS) + " from posi")
def positional_landscape(spark, d):
    return tidy(_posi(spark, d).select(*P.CELL, "position", "letter", *POS_COLS))


@query("accumulation_metrics", f"with {POSI} select sample, unit, {INT}, strand, cast(position as bigint) as position, letter, " + ", ".join(f"round(accumulation_{c}, 8) as accumulation_{c}" for c in ("ratio", "delta", "log2")) + " from posi")
def accumulation_metrics(spark, d):
    return tidy(_posi(spark, d).select(*P.CELL, "position", "letter", "accumulation_ratio", "accumulation_delta", "accumulation_log2"))


@query("gc_slice", f"""with {LETTERED} select sample, unit, round(avg(length(regexp_replace(substr(seq, 9, 6), '[^GC]', '', 'g')) / 6.0), 8) as gc_9_14, round(avg(length(regexp_replace(seq, '[^GC]', '', 'g')) / length(seq)), 8) as gc,
 count(*) as n from lettered group by all""")
def gc_slice(spark, d):
    r = lettered(spark, d)
    return tidy(r.groupBy("sample", "unit").agg(F.avg(S.gc_fraction("sequence", 9, 6)).alias("gc_9_14"), F.avg(S.gc_fraction("sequence")).alias("gc"), F.count(F.lit(1)).alias("n")))


@query("gc_regional_windows", f"""with {POSI}, gc as (select sample, unit, length, strand, mode, position, sum(fraction) as gc from obs where letter in ('G', 'C') group by all),
 w as (select *, avg(gc) over f as gc_mean, count(gc) over f as c, count(*) over f as n from gc window f as (partition by sample, unit, length, strand, mode order by position rows between current row and 5 following))
 select sample, unit, {INT}, strand, mode, cast(position as bigint) as position, round(gc, 8) as gc, round(case when c = 6 then gc_mean end, 8) as gc_mean from w where n = 6""")
def gc_regional_windows(spark, d):
    return tidy(P.gc_windows(_pobs(spark, d), 6))


GROUPS = {7: ("A", "T"), 10: ("A", "G"), 17: ("A", "T")}


@query("grouped_letters", f"""with {POSI} select sample, unit, {INT}, strand, mode, cast(position as bigint) as position, round(sum(fraction), 8) as share, string_agg(letter, '' order by letter) as letters from obs
 where (position = 7 and letter in ('A', 'T')) or (position = 10 and letter in ('A', 'G')) or (position = 17 and letter in ('A', 'T')) group by all""")
def grouped_letters(spark, d):
    return tidy(P.grouped_letters(_pobs(spark, d), GROUPS))


def _cross(coord: str) -> str:
    return f"""with {POSI}, i as (select *, {coord} as coordinate from q where inner_position),
 c as (select strand, letter, coordinate, a.n_positive as pl, a.n_negative as nl, b.n_positive as ph, b.n_negative as nh, a.q_by as ql, b.q_by as qh from i a join i b using (strand, letter, coordinate) where a.length = 23 and b.length = 24)
 select strand, letter, cast(coordinate as bigint) as coordinate, sign(pl - nl) = sign(ph - nh) as same_sign, coalesce(ql < 0.05 and qh < 0.05, false) as corrected_in_both, round(ql, 8) as q_by_low, round(qh, 8) as q_by_high from c"""


def _cross_df(spark, d, from_3p):
    c = P.cross_length(_found(spark, d), 23, 24, from_3p)
    return tidy(c.select("strand", "letter", F.col("coordinate").cast("bigint").alias("coordinate"), "same_sign", "corrected_in_both", "q_by_low", "q_by_high"))


@query("cross_length_same_5p", _cross("position"))
def cross_length_same_5p(spark, d):
    return _cross_df(spark, d, False)


@query("cross_length_same_3p", _cross("length - position + 1"))
def cross_length_same_3p(spark, d):
    return _cross_df(spark, d, True)


AGG_REPS = 20
#: Nine medians of three modes, the interval of the effect by digest draws, and the sign test of the difference.
AGGREGATE = """, pr as (select sample, length, strand, position, letter, """ + ", ".join(f"round({c}, 9) as {c}" for c in ["expected", *P.POSITION_METRICS[4:], "abundance_ratio", "unique_ratio"]) + """ from posi),
 pm as (select sample, length, strand, 'abundance' as mode, position, letter, abundance_fraction as observed, expected, abundance_ratio as enrichment, abundance_fraction - expected as delta,
   null::double as unique_fraction, null::double as abundance_fraction, null::double as accumulation_ratio, null::double as accumulation_delta, null::double as accumulation_log2 from pr
  union all select sample, length, strand, 'unique_sequence', position, letter, unique_fraction, expected, unique_ratio, unique_fraction - expected, null, null, null, null, null from pr
  union all select sample, length, strand, 'accumulation', position, letter, null, null, null, null, unique_fraction, abundance_fraction, accumulation_ratio, accumulation_delta, accumulation_log2 from pr),
 ps as (select length, strand, mode, position, letter, sample, """ + ", ".join(f"median({m}) as {m}" for m in P.POSITION_METRICS) + """ from pm group by all),
 pd as (select *, case when mode = 'accumulation' then accumulation_delta else delta end as dd, case when mode = 'accumulation' then accumulation_ratio else enrichment end as ee from ps),
 pa as (select length, strand, mode, position, letter, count(*) as n_samples_total, """ + ", ".join(f"median({m}) as {m}" for m in P.POSITION_METRICS) + """, count(ee) as n_samples, count(*) filter (dd > 0) as n_positive, count(*) filter (dd < 0) as n_negative,
   list(ee order by sample) filter (ee is not null) as v from pd where dd is not null group by all),""" + f"""
 pb as (select length, strand, mode, position, letter, b, median(v[1 + cast('0x' || substr(sha256(cast(b as varchar) || '|' || cast(i as varchar)), 1, 8) as bigint) % len(v)]) as e from pa, range(0, {AGG_REPS}) tb(b), range(0, 1000) ti(i) where i < len(v) group by all),
 pc as (select length, strand, mode, position, letter, quantile_cont(e, 0.025) as ci_low, quantile_cont(e, 0.975) as ci_high from pb group by all),
 pt as (select *, case when n_positive + n_negative > 0 then least(1.0, 2 * list_sum(list_transform(range(0, least(n_positive, n_negative) + 1),
   lambda k: cast(factorial(cast(n_positive + n_negative as int)) / (factorial(cast(k as int)) * factorial(cast(n_positive + n_negative - k as int))) as double))) / pow(2.0, n_positive + n_negative)) end as p,
   position between 3 and length - 2 as inner_position from pa left join pc using (length, strand, mode, position, letter))"""


def _aggregate(spark, d):
    pos = _posi(spark, d)
    return P.positional_aggregate(pos.withColumns({c: F.round(c, 9) for c in ["expected", *P.POSITION_METRICS[4:], "abundance_ratio", "unique_ratio"]}), AGG_REPS)


@query("positional_aggregate", f"""with {POSI}{AGGREGATE}, pf as (select *, case when inner_position then p end as pf from pt),
 pk as (select *, count(*) over w as m, row_number() over (partition by length, mode, strand, pf is not null order by pf, position, letter) as i from pf window w as (partition by length, mode, strand, pf is not null)),
 pq as (select *, case when pf is not null then least(1.0, min(pf * m / i) over w) end as q_bh, case when pf is not null then least(1.0, min(pf * m * list_sum(list_transform(range(1, m + 1), lambda k: 1.0::double / k)) / i) over w) end as q_by
  from pk window w as (partition by length, mode, strand, pf is not null order by i desc rows between unbounded preceding and current row))
 select {INT}, strand, mode, cast(position as bigint) as position, letter, n_samples_total, """ + ", ".join(f"round({m}, 8) as {m}" for m in P.POSITION_METRICS) + """, n_samples, n_positive, n_negative, round(ci_low, 8) as ci_low, round(ci_high, 8) as ci_high, round(p, 8) as p, round(q_bh, 8) as q_bh, round(q_by, 8) as q_by from pq""")
def positional_aggregate(spark, d):
    cols = ["length", "strand", "mode", "position", "letter", "n_samples_total", *P.POSITION_METRICS, "n_samples", "n_positive", "n_negative", "ci_low", "ci_high", "p", "q_bh", "q_by"]
    return tidy(_aggregate(spark, d).select(*cols))


FAMILIES = {"q_endpoint": "length, mode, strand", "q_length": "length", "q_strand": "strand", "q_letter": "letter", "q_all": ""}
_PART = {n: (f"partition by {k}" if k else "") for n, k in FAMILIES.items()}


@query("step_up_families", f"""with {POSI}{AGGREGATE}, pu as (select length, strand, mode, position, letter, p from pt where inner_position and p is not null),
 pi as (select *, """ + ", ".join(f"count(*) over ({w}) as m_{n}, row_number() over ({w} order by p, length, strand, mode, position, letter) as i_{n}" for n, w in _PART.items()) + f""" from pu)
 select {INT}, strand, mode, cast(position as bigint) as position, letter, round(p, 8) as p, """ + ", ".join(f"round(least(1.0, min(p * m_{n} / i_{n}) over ({w} order by i_{n} desc rows between unbounded preceding and current row)), 8) as {n}" for n, w in _PART.items()) + " from pi")
def step_up_families(spark, d):
    """Five families over the same tests, one of all of them, stepped up in one pass."""
    inner = _aggregate(spark, d).filter(F.col("position").between(3, F.col("length") - 2) & F.col("p").isNotNull()).select("length", "strand", "mode", "position", "letter", "p")
    families = {n: ([x for x in k.split(", ") if x], None) for n, k in FAMILIES.items()}
    return tidy(T.adjust_families(inner, P.POSITION_KEYS, families, "p"))


#: The binomial tail by log-gamma: groups of thousands of differences.
@query("sign_test_large", """with n as (select l_returnflag, l_linestatus, count(*) filter (l_quantity > 25) as n_positive, count(*) filter (l_quantity < 25) as n_negative from lineitem group by all),
 t as (select l_returnflag, l_linestatus, n_positive, n_negative, n_positive + n_negative as n, unnest(range(0, least(n_positive, n_negative) + 1)) as i from n)
 select l_returnflag, l_linestatus, n_positive, n_negative, round(least(1, 2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)))), 7) as p from t group by all""")
def sign_test_large(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_quantity") - 25).alias("difference"))
    return T.sign_test(rows, ["l_returnflag", "l_linestatus"], "difference").drop("status").withColumn("p", F.round("p", 7))


@query("sign_test", f"with {POSI} select {INT}, strand, cast(position as bigint) as position, letter, n_positive, n_negative, round(p, 8) as p from st")
def sign_test(spark, d):
    return tidy(_found(spark, d).select("length", "strand", "position", "letter", "n_positive", "n_negative", "p"))


@query("bh_adjust", f"with {POSI} select {INT}, strand, cast(position as bigint) as position, letter, round(p_family, 8) as p_family, round(q_bh, 8) as q_bh from q")
def bh_adjust(spark, d):
    return tidy(_found(spark, d).select("length", "strand", "position", "letter", "p_family", "q_bh"))


@query("by_adjust", f"with {POSI} select {INT}, strand, cast(position as bigint) as position, letter, round(p_family, 8) as p_family, round(q_by, 8) as q_by from q")
def by_adjust(spark, d):
    return tidy(_found(spark, d).select("length", "strand", "position", "letter", "p_family", "q_by"))


@query("evidence_case", f"""with {POSI}, c as (select strand, letter, position, a.length as length, coalesce(a.q_bh < 0.5, false) as corrected, sign(a.n_positive - a.n_negative) = sign(b.n_positive - b.n_negative) as same_sign, coalesce(b.q_bh < 0.5, false) as cross_length
 from q a join q b using (strand, letter, position) where a.length = 23 and b.length = 24 and a.inner_position and b.inner_position)
 select strand, letter, cast(position as bigint) as position, case when corrected and same_sign and cross_length then 'HIGH' when corrected and same_sign then 'SUPPORTIVE' when corrected or cross_length then 'CONTEXT_ONLY' else 'NOT_DEFAULT' end as evidence from c""")
def evidence_case(spark, d):
    inner = _found(spark, d).filter("inner")
    both = J.across_values(inner, ["strand", "letter", "position"], "length", 23, 24, ["n_positive", "n_negative", "q_bh"])
    sign = lambda t: F.signum(F.col(f"n_positive_{t}") - F.col(f"n_negative_{t}"))
    low = lambda t: F.coalesce(F.col(f"q_bh_{t}") < 0.5, F.lit(False))
    return tidy(both.select("strand", "letter", F.col("position").cast("bigint").alias("position"), P.evidence_class(low("low"), sign("low") == sign("high"), low("high")).alias("evidence")))


def _universe(spark, d):
    b = background(spark, d)
    w = P.background_windows(b, [23, 24]).filter("valid").select("sample", "unit", F.col("length").cast("bigint").alias("length"), S.revcomp("window").alias("sequence")).distinct()
    # half of the observed sequences come from the background itself, so that both outcomes occur
    planted = w.filter(F.conv(F.substring(F.sha2("sequence", 256), 1, 1), 16, 10).cast("int") < 4).withColumn("count", F.lit(2).cast("bigint"))
    seen = lettered(spark, d).filter("strand = 'antisense'").select("sample", "unit", "length", "sequence", "count").unionByName(planted.select("sample", "unit", "length", "sequence", "count"))
    return w, seen.groupBy("sample", "unit", "length", "sequence").agg(F.sum("count").alias("count"))


UNI = f"""{OPP}, planted as (select sample, unit, length, seq, 2 as cnt from opp where substr(sha256(seq), 1, 1) in ('0', '1', '2', '3')),
 seen as (select sample, unit, length, seq, sum(cnt) as cnt from (select sample, unit, length, seq, cnt from lettered where strand = 'antisense' union all select * from planted) group by all)"""


@query("opportunity_left", f"with {UNI} select sample, unit, {INT}, seq as sequence, cast(coalesce(cnt, 0) as bigint) as count, cast(coalesce(cnt, 0) > 0 as bigint) as represented from opp left join seen using (sample, unit, length, seq)")
def opportunity_left(spark, d):
    w, seen = _universe(spark, d)
    return tidy(J.opportunity_match(w, seen, ["sample", "unit", "length", "sequence"], "count"))


@query("opportunity_semi", f"with {UNI} select sample, unit, {INT}, seq as sequence, cast(cnt as bigint) as count from seen semi join opp using (sample, unit, length, seq)")
def opportunity_semi(spark, d):
    w, seen = _universe(spark, d)
    return tidy(J.supported(seen, w, ["sample", "unit", "length", "sequence"]))


@query("opportunity_anti", f"with {UNI} select sample, unit, count(*) as n, cast(sum(cnt) as bigint) as abundance from (select * from seen anti join opp using (sample, unit, length, seq)) group by all")
def opportunity_anti(spark, d):
    w, seen = _universe(spark, d)
    return tidy(J.unsupported(seen, w, ["sample", "unit", "length", "sequence"]).groupBy("sample", "unit").agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("abundance")))


@query("empirical_p", f"""with {POSI}, o as (select length, strand, max(abs(accumulation_delta)) as obs from posi where position = 10 group by all), nl as (select length, strand, abs(accumulation_delta) as v from posi where position <> 10)
 select cast(length as bigint) as length, strand, round(obs, 8) as obs, count(*) filter (round(v, 9) >= round(obs, 9)) as n_exceed, count(v) as n_null, round((count(*) filter (round(v, 9) >= round(obs, 9)) + 1) / (count(v) + 1), 8) as p from o join nl using (length, strand) group by all""")
def empirical_p(spark, d):
    p = _posi(spark, d).withColumn("v", F.round(F.abs("accumulation_delta"), 9))
    observed = p.filter("position = 10").groupBy("length", "strand").agg(F.max("v").alias("obs"))
    return tidy(T.empirical_p(p.filter("position <> 10").select("length", "strand", "v"), observed, ["length", "strand"], "v", "obs"))


REGIONS = f"""{POSI}, g as (select {CELL}, mode, position, sum(fraction) as gc from obs where letter in ('G', 'C') group by all), ge as (select {CELL}, position, sum(expected) as gc from exp where letter in ('G', 'C') group by all),
 go as (select *, avg(gc) over f as m, count(gc) over f as c, count(*) over f as k from g window f as (partition by {CELL}, mode order by position rows between current row and 5 following)),
 gx as (select *, avg(gc) over f as m, count(gc) over f as c, count(*) over f as k from ge window f as (partition by {CELL} order by position rows between current row and 5 following)),
 o6 as (select {CELL}, position, max(m) filter (mode = 'unique_sequence' and c = 6) as u, max(m) filter (mode = 'abundance' and c = 6) as a from go where k = 6 and position + 5 <= length group by all),
 e6 as (select {CELL}, position, case when c = 6 then m end as e from gx where k = 6), rg as (select o6.*, e from o6 left join e6 using ({CELL}, position)),
 rs as (select length, strand, position, sample, median(round(a - u, 9)) as m from rg group by all),
 r0 as (select length, strand, position, count(*) filter (m > 0) as n_positive, count(*) filter (m < 0) as n_negative, median(m) as estimate, count(m) as n_samples from rs group by all),
 r1 as (select *, case when n_positive + n_negative > 0 then least(1.0, 2 * list_sum(list_transform(range(0, least(n_positive, n_negative) + 1),
  lambda k: cast(factorial(cast(n_positive + n_negative as int)) / (factorial(cast(k as int)) * factorial(cast(n_positive + n_negative - k as int))) as double))) / pow(2.0, n_positive + n_negative)) end as p from r0),
 r2 as (select *, count(*) over (partition by length, strand, p is not null) as m, row_number() over (partition by length, strand, p is not null order by p, position) as i from r1),
 r3 as (select *, case when p is not null then least(1.0, min(p * m / i) over w) end as q_bh from r2 window w as (partition by length, strand, p is not null order by i desc rows between unbounded preceding and current row))"""


def _regional(spark, d):
    return P.regional(_pobs(spark, d), P.expected(background(spark, d), [23, 24], terminal=False), 6)


@query("regional_deltas", f"""with {REGIONS} select sample, unit, {INT}, strand, cast(position as bigint) as position, round(u, 8) as unique_sequence, round(a, 8) as abundance, round(e, 8) as expected, round(u - e, 8) as unique_delta, round(a - e, 8) as abundance_delta,
 round(a - u, 8) as accumulation_delta, cast(position + 5 as bigint) as end_5p, cast(length - position - 4 as bigint) as near_3p, cast(length - position + 1 as bigint) as far_3p, 'GC' || position || '-' || (position + 5) as region_5p, 'GC_3p' || (length - position - 4) || '-' || (length - position + 1) as region_3p from rg""")
def regional_deltas(spark, d):
    return tidy(_regional(spark, d))


@query("regional_discovery", f"with {REGIONS} select {INT}, strand, cast(position as bigint) as position, n_positive, n_negative, round(estimate, 8) as estimate, n_samples, round(p, 8) as p, round(q_bh, 8) as q_bh from r3")
def regional_discovery(spark, d):
    r = _regional(spark, d).withColumn("accumulation_delta", F.round("accumulation_delta", 9))
    return tidy(P.regional_discovery(r, "accumulation_delta").select("length", "strand", "position", "n_positive", "n_negative", "estimate", "n_samples", "p", "q_bh"))


@query("support_text", f"""with {POSI} select {INT}, strand, cast(position as bigint) as position, letter, case when p is null or q_bh is null then 'not estimable' else 'effect=' || format('{{:.6g}}', round(n_positive / 7.0, 9)) || '; delta=' || format('{{:.6g}}', round(p - 0.5, 9)) || '; corrected_p=' || format('{{:.6g}}', round(q_bh, 9)) end as support from q""")
def support_text(spark, d):
    from ..functions import nulls as N

    f = _found(spark, d)
    return tidy(f.select("length", "strand", "position", "letter", N.support_text(F.round(F.col("n_positive") / 7.0, 9), F.round(F.col("p") - 0.5, 9), F.round("q_bh", 9)).alias("support")))


@query("endpoint_labels", f"with {TERM} select case when mode = 'unique_sequence' then 'unique_representation' else 'abundance_representation' end as endpoint, count(*) as n, round(median(ratio), 8) as ratio from enr group by 1")
def endpoint_labels(spark, d):
    from ..functions import nulls as N

    return tidy(_enr(spark, d).groupBy(N.representation_endpoint("mode").alias("endpoint")).agg(F.count(F.lit(1)).alias("n"), F.median("ratio").alias("ratio")))

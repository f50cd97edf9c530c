"""Queries of input validation: alignments, features and sequences that the tables yield, some of them made faulty."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import validation as V
from .roles import BACKGROUND, HEX, LETTERED, LETTERS, READS, background, lettered, letters_of, query, reads, table

PROGRAM = V.program_pattern("mapper", "1.3.1", "-v 0")
SIZE = 236


def _faults(names: list[str]) -> str:
    """Status and faults of counted columns in SQL."""
    total = " + ".join(f"coalesce({n}, 0)" for n in names)
    text = ", ".join(f"case when {n} > 0 then '{n}=' || cast({n} as bigint) end" for n in names)
    return f"case when {total} = 0 then 'PASS' else 'FAIL' end as status, cast(coalesce(n, 0) as bigint) as observed, concat_ws('; ', {text}) as faults"


ALIGN = f"""rec as (select sample, case when identity % 89 = 0 then 10 else 12 end as n_fields, case when strand = 'sense' then 0 else 16 end + case when identity % 97 = 0 then 4 else 0 end as flag,
  case when identity % 83 = 0 then 'none' else contig end as contig, s as position, case when identity % 79 = 0 then '*' when length < 4 then length || 'M' else '2S' || (length - 3) || 'M1D1M' end as cigar,
  'NM:i:' || case when identity % 73 = 0 then 1 else 0 end as tag from reads),
 heads as (select distinct sample, contig, {SIZE} + case when grp = 1 and contig = '7' then 1 else 0 end as contig_length from reads),
 judged as (select sample, case when n_fields < 11 then 'fields' when flag & 4 <> 0 then 'unmapped' when contig_length is null then 'contig' when not regexp_full_match(cigar, '([0-9]+[MIDNSHP=X])+') then 'cigar'
   when position < 1 or span < 1 or position + span - 1 > contig_length then 'bounds' when tag <> 'NM:i:0' then 'edit_distance' end as f
  from (select *, list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1), lambda x: cast(x as bigint))) as span from rec) left join heads using (sample, contig)),
 aligned as (select sample, count(*) as n, """ + ", ".join(f"count(*) filter (f = '{x}') as {x}" for x in V.RECORD_FAULTS) + f""", 0 as header from judged group by sample),
 dict as (select sample, 2 * count(*) filter (contig_length <> {SIZE}) as dictionary from heads group by sample),
 alignments as (select 'alignments' as "check", sample as scope, {_faults([*V.RECORD_FAULTS, "header", "dictionary", "program"])}
  from aligned join dict using (sample) join (select n_name as sample, case when n_nationkey % 2 = 0 then 0 else 1 end as program from nation) using (sample))"""


def _alignments(spark, d):
    r = reads(spark, d)
    bad = lambda n: F.col("identity") % n == 0
    records = r.select(
        "sample", F.when(bad(89), 10).otherwise(12).alias("n_fields"), (F.when(F.col("strand") == "sense", 0).otherwise(16) + F.when(bad(97), 4).otherwise(0)).alias("flag"),
        F.when(bad(83), "none").otherwise(F.col("contig")).alias("contig"), F.col("start").alias("position"),
        F.when(bad(79), "*").when(F.col("length") < 4, F.concat("length", F.lit("M"))).otherwise(F.concat(F.lit("2S"), F.col("length") - 3, F.lit("M1D1M"))).alias("cigar"),
        F.array(F.concat(F.lit("NM:i:"), F.when(bad(73), "1").otherwise("0"))).alias("tags"),
    )
    contigs = r.select("sample", "grp", "contig").distinct()
    header = contigs.select("sample", "contig", F.when((F.col("grp") == 1) & (F.col("contig") == "7"), SIZE + 1).otherwise(SIZE).alias("contig_length"))
    line = F.concat(F.lit("@PG\tID:mapper\tVN:1.3.1\tCL:mapper -v "), F.when(F.col("n_nationkey") % 2 == 0, "0").otherwise("2"), F.lit(" x"))
    programs = table(spark, d, "nation").select(F.col("n_name").alias("sample"), line.alias("line"))
    return V.alignment_checks(records, header, contigs.select("sample", "contig", F.lit(SIZE).alias("contig_length")), programs, "sample", PROGRAM)


@query("alignment_validation", f"with {READS}, {ALIGN} select * from alignments")
def alignment_validation(spark, d):
    return _alignments(spark, d)


FEATURES = f"""feat as (select sample, unit, seq, length + case when identity % 101 = 0 then 1 else 0 end as length, cnt - case when identity % 103 = 0 then 100 else 0 end as cnt, strand = 'sense' as assigned, cnt > 3 as exact from lettered),
 pairs as (select sample, unit, count(*) as n, count(*) filter (cnt < 0) as numbers, count(*) filter (cnt >= 0 and length(seq) <> length) as wrong, count(*) filter (assigned) as a, count(*) filter (assigned and exact) as e from feat group by all),
 eligible as (select distinct sample, unit from reads where unit <> 'N' or grp = 1), positive as (select distinct sample, unit from reads where cnt = 7),
 joined as (select coalesce(p.sample, q.sample) as sample, p.n, p.numbers, p.wrong, case when el.sample is null then p.a end as off, case when q.sample is not null and coalesce(p.e, 0) = 0 then 1 else 0 end as lack
  from pairs p full join positive q on p.sample = q.sample and p.unit = q.unit left join eligible el on el.sample = p.sample and el.unit = p.unit),
 features as (select 'features' as "check", sample as scope, {_faults(["numbers", "length", "pair", "lacking"])} from (select sample, sum(n) as n, sum(numbers) as numbers, sum(wrong) as length, sum(off) as pair, sum(lack) as lacking from joined group by sample)),
 categories as (select 'categories_unit' as "check", sample as scope, 'INFO' as status, count(distinct unit) as observed, string_agg(distinct unit, ',' order by unit) as faults from reads group by sample)"""


def _features(spark, d):
    r = reads(spark, d)
    off = lambda n, by: F.when(F.col("identity") % n == 0, by).otherwise(0)
    rows = lettered(spark, d).select(
        "sample", "unit", "sequence", (F.col("length") + off(101, 1)).alias("length"), (F.col("count") - off(103, 100)).alias("count"), F.lit(1).alias("loci"),
        (F.col("strand") == "sense").alias("assigned"), (F.col("count") > 3).alias("exact"),
    )
    checks = V.feature_checks(rows, r.filter("unit <> 'N' or grp = 1"), r.filter("count = 7"), "sample", "unit")
    return checks, V.category_rows(r, "sample", ["unit"])


@query("feature_validation", f"with {LETTERED}, {FEATURES} select * from features union all select * from categories")
def feature_validation(spark, d):
    return V.composite(*_features(spark, d))


SEQUENCES = f"""masked as (select sample, unit, unit || '|' || record as id, seq || case when unit = 'A' and record = 1 and grp = 1 then 'A' else '' end as b from background join (select distinct sample, grp from reads) using (sample) where not (unit = 'R' and record = 0 and grp = 4)),
 fin as (select sample, unit, unit || '|' || record as id, translate(sha256(sample || '|' || unit || '|' || cast(record as varchar)), '{HEX}', '{LETTERS}') as f from background),
 whole as (select sample, unit, id, case when unit = 'N' and id = 'N|1' then reverse(f) else f end as w from fin join (select distinct sample, grp from reads) using (sample) where not (unit = 'A' and id = 'A|2' and grp = 3)),
 three as (select *, length(f) = length(b) as same from fin full join masked using (sample, unit, id) full join whole using (sample, unit, id)),
 sums as (select sample, unit, count(f) as n, 0 as owner, count(*) filter ((f is null) <> (b is null)) as background_ids, count(*) filter ((f is null) <> (w is null)) as whole_ids, count(*) filter (f <> w) as whole_sequence,
  count(*) filter (not same) as background_length, 0 as substitution, coalesce(sum(length(f)), 0) <> 192 as reference_length, coalesce(sum(length(b)), 0) <> 192 as background_total,
  coalesce(sum(length(replace(b, 'N', ''))), 0) <> 180 as background_usable from three group by all),
 sequences as (select 'sequences' as "check", sample || ':' || unit as scope, {_faults(V.SEQUENCE_FAULTS)} from (select * replace (cast(reference_length as int) as reference_length, cast(background_total as int) as background_total, cast(background_usable as int) as background_usable) from sums))"""


def _sequences(spark, d):
    key = ["sample", "unit"]
    b = background(spark, d).join(reads(spark, d).select("sample", "grp").distinct(), "sample").withColumn("id", F.concat("unit", F.lit("|"), F.col("record")))
    f = b.withColumn("sequence", letters_of(F.concat_ws("|", "sample", "unit", F.col("record").cast("string"))))
    extra = F.when((F.col("unit") == "A") & (F.col("record") == 1) & (F.col("grp") == 1), "A").otherwise("")
    masked = b.filter("not (unit = 'R' and record = 0 and grp = 4)").withColumn("sequence", F.concat("sequence", extra))
    whole = f.filter("not (unit = 'A' and id = 'A|2' and grp = 3)").withColumn("sequence", F.when(F.col("id") == "N|1", F.reverse("sequence")).otherwise(F.col("sequence")))
    eligible = b.select(*key).distinct().select(*key, F.lit(192).alias("reference_length"), F.lit(192).alias("background_total"), F.lit(180).alias("background_usable"))
    return V.sequence_checks(f, masked, whole, eligible, "sample", "unit")


@query("sequence_validation", f"with {READS}, {BACKGROUND}, {SEQUENCES} select * from sequences")
def sequence_validation(spark, d):
    return _sequences(spark, d)


@query("validation_ledger", f"""with {LETTERED}, {BACKGROUND}, {ALIGN}, {FEATURES}, {SEQUENCES},
 cover as (select 'samples' as "check", 'all' as scope, {_faults(["missing", "unexpected", "repeated"])} from (select count(s.sample) as n, count(*) filter (s.sample is null) as missing, count(*) filter (n_name is null) as unexpected, 0 as repeated from (select distinct sample from reads) s full join nation on sample = n_name)),
 manifest as (select 'manifest' as "check", 'all' as scope, {_faults(["missing", "unexpected", "repeated"])} from (select sum(f) as n, count(*) filter (f = 0) as missing, count(*) filter (w = 0) as unexpected, count(*) filter (f > 1) as repeated
  from (select coalesce(x.sample, y.sample) as s, coalesce(f, 0) as f, case when y.sample is null then 0 else 1 end as w from (select sample, unit, count(*) as f from (select sample, unit from reads where cnt = 7 and identity % 50 = 0) group by all) x full join eligible y on x.sample = y.sample and x.unit = y.unit))),
 owned as (select 'catalogue' as "check", 'all' as scope, {_faults(["conflicts"])} from (select count(*) as n, count(*) filter (eligible.sample is null) as conflicts from reads left join eligible using (sample, unit)))
 select * from alignments union all select * from features union all select * from categories union all select * from sequences union all select * from cover union all select * from manifest union all select * from owned""")
def validation_ledger(spark, d):
    r = reads(spark, d)
    eligible = r.filter("unit <> 'N' or grp = 1").select("sample", "unit").distinct()
    nations = table(spark, d, "nation").select(F.col("n_name").alias("sample"))
    return V.composite(
        _alignments(spark, d), *_features(spark, d), _sequences(spark, d), V.same_keys("samples", r.select("sample").distinct(), nations, ["sample"]),
        V.same_keys("manifest", r.filter("count = 7 and identity % 50 = 0"), eligible, ["sample", "unit"]), V.owned_by("catalogue", r, eligible, ["sample", "unit"]),
    )

"""Queries of the data-quality operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import quality as Q
from .roles import READS, query, reads, table, tidy


@query("quality_ledger", """with a as (select count(*) as n_rows, count(*) filter (l_quantity < 1 or l_quantity > 50) as bad_quantity, count(*) - count(l_partkey) as missing_part, max(l_linenumber) as max_line from lineitem)
 select 'rows' as check, case when n_rows > 0 then 'PASS' else 'FAIL' end as status, cast(n_rows as varchar) as value, '' as details from a
 union all select 'bad_quantity', case when bad_quantity = 0 then 'PASS' else 'FAIL' end, cast(bad_quantity as varchar), '' from a
 union all select 'missing_part', case when missing_part = 0 then 'PASS' else 'FAIL' end, cast(missing_part as varchar), '' from a
 union all select 'max_line', case when max_line < 7 then 'PASS' else 'FAIL' end, cast(max_line as varchar), '' from a""")
def quality_ledger(spark, d):
    zero = lambda c: c == 0
    return Q.ledger(table(spark, d, "lineitem"), {
        "rows": (F.count(F.lit(1)), lambda c: c > 0), "bad_quantity": (F.count_if((F.col("l_quantity") < 1) | (F.col("l_quantity") > 50)), zero),
        "missing_part": (F.count_if(F.col("l_partkey").isNull()), zero), "max_line": (F.max("l_linenumber"), lambda c: c < 7),
    })


@query("unexpected_categories", "select event_type, count(*) as n from events where event_type is null or event_type not in ('view', 'click', 'purchase') group by 1")
def unexpected_categories(spark, d):
    return Q.unexpected_categories(table(spark, d, "events"), "event_type", ["view", "click", "purchase"])


@query("duplicate_keys", "select l_orderkey, l_partkey, count(*) as n from lineitem group by all having count(*) > 1")
def duplicate_keys(spark, d):
    return Q.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_partkey"])


@query("key_set_difference", "select o_custkey as k, 'left' as side from (select distinct o_custkey from orders) anti join customer on c_custkey = o_custkey union all select c_custkey, 'right' from customer anti join orders on c_custkey = o_custkey")
def key_set_difference(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return Q.same_key_sets(o, table(spark, d, "customer").select(F.col("c_custkey").alias("k")), ["k"])


@query("regression_compare", """with o as (select o_custkey as k, round(sum(o_totalprice), 2) as v from orders group by 1), c as (select c_custkey as k, c_acctbal as v from customer)
 select coalesce(o.k, c.k) as k, round(abs(o.v - c.v), 4) as v_diff, coalesce((o.v is null and c.v is null) or abs(o.v - c.v) <= 1000, false) and o.k is not null and c.k is not null as agrees from o full join c on o.k = c.k""")
def regression_compare(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return tidy(Q.compare_relations(o, c, ["k"], ["v"], 1000.0).select("k", "v_diff", "agrees"), 4)


@query("accounting", f"""with {READS} select unit, count(*) as examined, count(*) filter (length between 15 and 35 and cnt <= 5) as retained, count(*) filter (length not between 15 and 35) as excluded_length,
 count(*) filter (length between 15 and 35 and cnt > 5) as excluded_count from reads group by 1""")
def accounting(spark, d):
    return A.accounting(reads(spark, d), {"length": ~F.col("length").between(15, 35), "count": F.col("count") > 5}, ["unit"])


@query("sum_deviation", f"with {READS}, s as (select sample, unit, cnt / sum(cnt) over (partition by sample, unit) as f from reads) select round(max(abs(t - 1)), 8) as max_deviation from (select sum(f) as t from s group by sample, unit)")
def sum_deviation(spark, d):
    shared = A.share_of_total(reads(spark, d), ["sample", "unit"], "count", "f")
    return tidy(A.sum_deviation(shared, ["sample", "unit"], "f"))


@query("category_text", f"with {READS} select sample, string_agg(distinct unit, ',' order by unit) as units from reads group by 1")
def category_text(spark, d):
    return reads(spark, d).groupBy("sample").agg(A.text_set("unit").alias("units"))

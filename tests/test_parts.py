"""Metrics of the candidates do not hang on the order of the rows that they sum."""

import duckdb
import pytest
from pyspark.sql import functions as F

from corvane.catalog import ORACLE, QUERIES
from corvane.catalog.roles import parts
from corvane.operators.aggregates import rounded_mean
from corvane.plans.candidates import layer_agreement, layer_scores

from .oracle import compare


def test_mean_halfway_between_two_figures_is_rounded_up_in_any_order(spark, tmp_path):
    # 93 hundredths over 32 rows are 0.0290625; in this order their doubles sum to less
    hundredths = [1, 4, 3, 1, 3, 1, 2, 4, 4, 3, 3, 4, 1, 5, 4, 0, 1, 0, 2, 0, 1, 1, 3, 9, 0, 5, 0, 2, 7, 2, 9, 8]
    orders = [hundredths, sorted(hundredths), sorted(hundredths, reverse=True), hundredths[1::2] + hundredths[::2]]
    rows = [(1, part, n, h / 100) for part, order in enumerate(orders) for n, h in enumerate(order)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_discount double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(p, "b", 1, 1.0) for p in range(len(orders))], "p_partkey long, p_brand string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    assert [r["m3"] for r in parts(spark, str(tmp_path)).collect()] == [0.029063] * len(orders)


def test_values_that_no_decimal_holds_are_averaged_as_doubles(spark):
    df = spark.createDataFrame([("a", 1e30), ("a", 3e30), ("b", float("inf")), ("c", None), ("d", 0.25), ("d", None)], "k string, x double")
    got = {r["k"]: r["m"] for r in df.groupBy("k").agg(rounded_mean("x", 1).alias("m")).collect()}
    assert got == {"a": 2e30, "b": float("inf"), "c": None, "d": 0.3}


def test_candidates_and_means_meet_without_a_broadcast(spark):
    plan = parts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_layers_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def watched(x):
        seen.add(1)
        return x

    rows = [(k, i, float(i % 7), float(i * i % 11)) for k in "ab" for i in range(30)]
    df = spark.createDataFrame(rows, "k string, id long, x double, y double").withColumn("x", watched("x"))
    layers = layer_scores(df, ["k"], ["x", "y"])
    once = seen.value
    found = layer_agreement(layers, ["k"], ["x_pct", "y_pct"]).collect()
    assert {(r["k"], r["n"]) for r in found} == {("a", 30), ("b", 30)} and len({r["rho"] for r in found}) == 1
    assert seen.value == once >= len(rows)


@pytest.mark.parametrize("name", ["equal_layer_rank", "pareto_front"])
def test_query_equals_sql_on_many_threads_where_means_need_no_sum(spark, tmp_path, name):
    # one row a part, its mean already rounded; three copies of every part, so that equal vectors meet
    con, d = duckdb.connect(), "/root/testdata/sf0.01"
    con.execute("set threads = 8")
    con.execute(f"create table once as select l_partkey, round(sum(round(l_discount * 100)) / 100 / count(*), 6) as l_discount from '{d}/lineitem.parquet' group by 1")
    for t, key, rows in (("lineitem", "l_partkey", "once"), ("part", "p_partkey", f"'{d}/part.parquet'")):
        path = f"{tmp_path}/{t}.parquet"
        con.execute(f"copy (select r.* replace ({key} + k * 1000000 as {key}) from range(3) c(k), {rows} r) to '{path}' (format parquet)")
        con.execute(f"create view {t} as select * from '{path}'")
    assert compare(spark, con, QUERIES[name], ORACLE[name], str(tmp_path)) == ""

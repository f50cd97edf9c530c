"""Letter counts are taken from the reads once, however often they are used."""

from pyspark.sql import functions as F

from corvane.functions import sequence as S
from corvane.plans import letters as P


def test_reads_are_taken_apart_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def watched(sequence):
        seen.add(1)
        return sequence

    rows = [(s, "u", 23, strand, letter * 23, 2) for s in "ab" for strand in ("sense", "antisense") for letter in "ACGT" for _ in range(3)]
    reads = spark.createDataFrame(rows, "sample string, unit string, length long, strand string, sequence string, count long").withColumn("sequence", watched("sequence"))
    counts = P.observed(reads)
    once = seen.value
    obs = P.dense_letters(P.with_combined(counts), list(S.TERMINALS), P.CELL)
    first, again = obs.collect(), obs.filter("strand = 'combined'").collect()
    assert len(first) == 2 * 3 * 4 * 4 * 2 and len(again) == 2 * 4 * 4 * 2
    assert {(r["mode"], r["n"], r["total"]) for r in again} == {("abundance", 12, 48), ("unique_sequence", 2, 8)}
    assert seen.value == once >= len(rows)

"""Validation of a run's inputs: alignments, feature tables, sequences, key sets and files, each check a row of one ledger.

A ledger row is (check, scope, status, observed, faults): what was checked, of
which sample or pair, PASS, FAIL or INFO, how many rows were seen, and the
faults found with their counts. Every relation is read once and reduced to
counts per scope before relations meet, so that only counts are shuffled.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S

LEDGER = ["check", "scope", "status", "observed", "faults"]
#: What may be wrong with an alignment record; of several faults the first counts.
RECORD_FAULTS = ["fields", "numbers", "unmapped", "contig", "cigar", "bounds", "edit_distance"]
_UNMAPPED = 0x4


def fault_rows(df: DataFrame, check: str, scope: Column, observed: Column, faults: Sequence[str]) -> DataFrame:
    """Ledger rows from counts of faults; a missing count is none."""
    counts = {f: F.coalesce(F.col(f).cast("long"), F.lit(0)) for f in faults}
    total = sum(counts.values(), F.lit(0))
    text = F.concat_ws("; ", *[F.when(n > 0, F.concat(F.lit(f"{f}="), n.cast("string"))) for f, n in counts.items()])
    status = F.when(total == 0, "PASS").otherwise("FAIL")
    return df.select(F.lit(check).alias("check"), scope.cast("string").alias("scope"), status.alias("status"), F.coalesce(observed.cast("long"), F.lit(0)).alias("observed"), text.alias("faults"))


def same_keys(check: str, found: DataFrame, wanted: DataFrame, keys: Sequence[str], scope: str | None = None) -> DataFrame:
    """Whether ``found`` holds each wanted key once and no other; one row, or one for each value of ``scope``, itself one of the keys.

    Both sides are stacked and counted by key; NULL keys equal each other. Two empty relations without a scope pass.
    """
    side = lambda df, n: df.select(*keys, F.lit(n).alias("_found"), F.lit(1 - n).alias("_wanted"))
    counts = side(found, 1).unionByName(side(wanted, 0)).groupBy(*keys).agg(F.sum("_found").alias("_f"), F.sum("_wanted").alias("_w"))
    agg = counts.groupBy(*[scope] if scope else []).agg(
        F.sum("_f").alias("n"), F.count_if(F.col("_f") == 0).alias("missing"), F.count_if(F.col("_w") == 0).alias("unexpected"), F.count_if(F.col("_f") > 1).alias("repeated"),
    )
    return fault_rows(agg, check, F.col(scope) if scope else F.lit("all"), F.col("n"), ["missing", "unexpected", "repeated"])


def owned_by(check: str, rows: DataFrame, catalogue: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whether the keys of all rows stand in the catalogue; NULL keys do not. One row."""
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    known = catalogue.select(*keys, F.lit(True).alias("_known")).distinct()
    agg = n.join(known, list(keys), "left").agg(F.sum("_n").alias("n"), F.sum(F.when(F.col("_known").isNull(), F.col("_n"))).alias("conflicts"))
    return fault_rows(agg, check, F.lit("all"), F.col("n"), ["conflicts"])


def row_total(check: str, rows: DataFrame, expected: int) -> DataFrame:
    """Whether a relation has the expected number of rows."""
    agg = rows.agg(F.count(F.lit(1)).alias("n"))
    return fault_rows(agg.withColumn("difference", F.abs(F.col("n") - expected)), check, F.lit("all"), F.col("n"), ["difference"])


def all_in_state(check: str, rows: DataFrame, column: str, state: str = "PASS") -> DataFrame:
    """Whether every row has the state; NULL has not. No row at all fails."""
    agg = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col(column).eqNullSafe(state)).alias("other"))
    return fault_rows(agg.withColumn("empty", (F.col("n") == 0).cast("int")), check, F.lit("all"), F.col("n"), ["other", "empty"])


def alignment_checks(records: DataFrame, header: DataFrame, reference: DataFrame, programs: DataFrame, scope: str, program: str) -> DataFrame:
    """Alignments of exact mappings against their header and the reference sequences; one row for each scope of ``reference``.

    ``records``: scope, n_fields, flag, contig, position (1-based), cigar, tags (array); numbers that were no numbers are NULL.
    ``header`` and ``reference``: scope, contig, contig_length. ``programs``: scope, line; one must match the pattern ``program``.
    A record is at fault if it has fewer than 11 fields, bad numbers, is unmapped, its contig is unknown, its CIGAR
    malformed, its span leaves the contig, or its edit distance is not 0; the header if it repeats a contig or its
    length is not positive (``header``) or it differs from the reference (``dictionary``).
    Scopes without records, header or programs are judged as empty.
    """
    lengths = header.groupBy(scope, "contig").agg(F.max("contig_length").alias("contig_length"), F.count(F.lit(1)).alias("_n"), F.count_if(F.coalesce(F.col("contig_length") <= 0, F.lit(True))).alias("_bad"))
    end = F.col("position") + S.cigar_span("cigar") - 1
    fault = (
        F.when(F.col("n_fields") < 11, "fields")
        .when(F.col("flag").isNull() | F.col("position").isNull(), "numbers")
        .when(F.col("flag").bitwiseAND(_UNMAPPED) != 0, "unmapped")
        .when(F.col("_n").isNull(), "contig")
        .when(~F.coalesce(F.col("cigar").rlike(r"^(\d{1,9}[MIDNSHP=X])+$"), F.lit(False)), "cigar")
        .when((F.col("position") < 1) | (end < F.col("position")) | F.coalesce(end > F.col("contig_length"), F.lit(True)), "bounds")
        .when(F.exists("tags", lambda t: t.startswith("NM:i:") & (t != "NM:i:0")), "edit_distance")
    )
    judged = records.join(lengths, [scope, "contig"], "left").select(scope, fault.alias("_fault"))
    seen = judged.groupBy(scope).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("_fault") == f).alias(f) for f in RECORD_FAULTS])
    heads = lengths.groupBy(scope).agg(F.sum((F.col("_n") > 1).cast("int") + F.col("_bad")).alias("header"))
    own, other = (df.select(scope, "contig", "contig_length").distinct() for df in (lengths, reference))
    sides = own.withColumn("_s", F.lit(1)).unionByName(other.withColumn("_s", F.lit(-1))).groupBy(scope, "contig", "contig_length").agg(F.sum("_s").alias("_s"))
    words = sides.groupBy(scope).agg(F.count_if(F.col("_s") != 0).alias("dictionary"))
    ran = programs.groupBy(scope).agg(F.max(F.col("line").rlike(program)).alias("_ran"))
    all_ = reference.select(scope).distinct().join(seen, scope, "left").join(heads, scope, "left").join(words, scope, "left").join(ran, scope, "left")
    all_ = all_.withColumn("program", (~F.coalesce("_ran", F.lit(False))).cast("int"))
    return fault_rows(all_, "alignments", F.col(scope), F.col("n"), [*RECORD_FAULTS, "header", "dictionary", "program"])


def program_pattern(name: str, version: str, option: str) -> str:
    """Pattern of a program line that names a program, its version and one of its options, in this order of tags or any other."""
    return rf"(?=.*\bID:{re.escape(name)})(?=.*\bVN:{re.escape(version)}(\s|$))(?=.*(^|\s){re.escape(option)}(\s|$))"


def feature_checks(rows: DataFrame, eligible: DataFrame, positive: DataFrame, scope: str, unit: str) -> DataFrame:
    """Feature tables: declared lengths, counts, and pairs that may or must occur; one row for each scope that has rows or must have some.

    ``rows``: scope, unit, sequence, length, count, loci, assigned and exact (booleans). ``eligible``: pairs an assigned row
    may have (``pair``). ``positive``: pairs that need an exact assigned row (``lacking``). Malformed numbers are NULL and count
    as ``numbers``.
    """
    number = F.col("length").isNull() | F.coalesce(F.col("count") < 0, F.lit(True)) | F.coalesce(F.col("loci") < 0, F.lit(True))
    wrong = F.coalesce(F.length("sequence") != F.col("length"), F.lit(False))
    assigned, exact = F.coalesce("assigned", F.lit(False)), F.coalesce("exact", F.lit(False))
    pairs = rows.groupBy(scope, unit).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(number).alias("numbers"), F.count_if(~number & wrong).alias("length"),
        F.count_if(assigned).alias("_assigned"), F.count_if(assigned & exact).alias("_exact"),
    )
    known = eligible.select(scope, unit, F.lit(True).alias("_known")).distinct()
    needed = positive.select(scope, unit, F.lit(True).alias("_needed")).distinct()
    joined = pairs.join(known, [scope, unit], "left").join(needed, [scope, unit], "full")
    agg = joined.groupBy(scope).agg(
        F.sum("n").alias("n"), F.sum("numbers").alias("numbers"), F.sum("length").alias("length"),
        F.sum(F.when(F.col("_known").isNull(), F.col("_assigned"))).alias("pair"), F.count_if(F.col("_needed") & (F.coalesce("_exact", F.lit(0)) == 0)).alias("lacking"),
    )
    return fault_rows(agg, "features", F.col(scope), F.col("n"), ["numbers", "length", "pair", "lacking"])


def category_rows(rows: DataFrame, scope: str, columns: Sequence[str]) -> DataFrame:
    """INFO rows that name the categories met, one for each scope and column; they constrain nothing."""
    long = rows.select(scope, F.inline(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("string").alias("_v")) for c in columns]))).distinct()
    agg = long.groupBy(scope, "_c").agg(F.count("_v").alias("observed"), F.concat_ws(",", F.array_sort(F.collect_set("_v"))).alias("faults"))
    return agg.select(F.concat(F.lit("categories_"), F.col("_c")).alias("check"), F.col(scope).cast("string").alias("scope"), F.lit("INFO").alias("status"), "observed", "faults")


#: What may be wrong with the sequences of a pair.
SEQUENCE_FAULTS = ["owner", "background_ids", "whole_ids", "whole_sequence", "background_length", "substitution", "reference_length", "background_total", "background_usable"]


def sequence_checks(final: DataFrame, background: DataFrame, whole: DataFrame, eligible: DataFrame, scope: str, unit: str, mask: str = "N") -> DataFrame:
    """Sequences of a pair against its masked background, the scope's whole set and the declared totals; one row for each eligible pair.

    ``final`` and ``background``: scope, unit, id, sequence; ``whole``: scope, id, sequence, where an id begins with its
    unit and a bar. ``eligible``: scope, unit, reference_length, background_total, background_usable. A background
    letter must be the original or the mask.
    """
    keys = [scope, unit, "id"]
    f = final.select(*keys, F.col("sequence").alias("_f"))
    b = background.select(*keys, F.col("sequence").alias("_b"))
    w = whole.select(scope, S.owner_prefix("id").alias(unit), "id", F.col("sequence").alias("_w"))
    rows = f.join(b, keys, "full").join(w, keys, "full")
    both, same = F.col("_f").isNotNull() & F.col("_b").isNotNull(), F.length("_f") == F.length("_b")
    # letters that were masked are masked on both sides before these are compared
    differs = F.exists(F.zip_with(F.split("_f", ""), F.split("_b", ""), lambda x, y: (x != y) & (y != mask)), lambda x: x)
    agg = rows.groupBy(scope, unit).agg(
        F.count("_f").alias("n"), F.count_if(F.col("_f").isNotNull() & (S.owner_prefix("id") != F.col(unit))).alias("owner"),
        F.count_if(F.col("_f").isNull() != F.col("_b").isNull()).alias("background_ids"), F.count_if(F.col("_f").isNull() != F.col("_w").isNull()).alias("whole_ids"),
        F.count_if(F.col("_f") != F.col("_w")).alias("whole_sequence"), F.count_if(both & ~same).alias("background_length"), F.count_if(both & same & differs).alias("substitution"),
        F.sum(F.length("_f")).alias("_rl"), F.sum(F.length("_b")).alias("_bt"), F.sum(F.length(F.replace("_b", F.lit(mask), F.lit("")))).alias("_bu"),
    )
    joined = eligible.select(scope, unit, "reference_length", "background_total", "background_usable").join(agg, [scope, unit], "left")
    off = {"reference_length": "_rl", "background_total": "_bt", "background_usable": "_bu"}
    joined = joined.withColumns({k: (~F.coalesce(F.col(c).cast("long"), F.lit(0)).eqNullSafe(F.col(k).cast("long"))).cast("int") for k, c in off.items()})
    return fault_rows(joined, "sequences", F.concat_ws(":", scope, unit), F.col("n"), SEQUENCE_FAULTS)


def file_identities(spark: SparkSession, paths: Sequence[str], block: int = 1 << 20) -> DataFrame:
    """(path, size, sha256, error) of files in a folder that all machines share, read in blocks by the tasks; one row for each distinct path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p in b["path"]:
                digest = hashlib.sha256()
                try:
                    with open(p, "rb") as f:
                        while part := f.read(block):
                            digest.update(part)
                    out.append((p, os.path.getsize(p), digest.hexdigest(), None))
                except OSError as e:
                    out.append((p, None, None, type(e).__name__))
            yield pd.DataFrame(out, columns=["path", "size", "sha256", "error"]).astype({"size": "Int64"})

    names = spark.createDataFrame([(p,) for p in sorted(set(paths))], "path string")
    return names.repartition(max(1, min(len(set(paths)), 1000)), "path").mapInPandas(run, "path string, size long, sha256 string, error string")


def file_checks(identities: DataFrame) -> DataFrame:
    """Ledger rows of file identities: unreadable or empty files fail."""
    df = identities.withColumns({"unreadable": F.col("error").isNotNull().cast("int"), "empty": F.coalesce(F.col("size") == 0, F.lit(False)).cast("int")})
    return fault_rows(df, "file", F.col("path"), F.col("size"), ["unreadable", "empty"])


def outside(check: str, spark: SparkSession, outputs: Sequence[str], root: str) -> DataFrame:
    """Whether all output paths lie outside a folder, links resolved."""
    top = os.path.realpath(root)
    inside = sum(os.path.commonpath([os.path.realpath(p), top]) == top for p in outputs)
    return fault_rows(spark.createDataFrame([(len(outputs), inside)], "n long, inside long"), check, F.lit("all"), F.col("n"), ["inside"])


def composite(*parts: DataFrame) -> DataFrame:
    """All checks as one ledger."""
    out = parts[0].select(*LEDGER)
    for p in parts[1:]:
        out = out.unionByName(p.select(*LEDGER))
    return out


def verdict(checks: DataFrame) -> DataFrame:
    """One row: how many checks there are of each state, and FAIL if one failed."""
    n = {s: F.count_if(F.col("status") == s) for s in ("PASS", "WARN", "FAIL", "INFO")}
    agg = checks.agg(*[c.alias(f"n_{s.lower()}") for s, c in n.items()])
    return agg.withColumn("status", F.when(F.col("n_fail") > 0, "FAIL").otherwise("PASS"))

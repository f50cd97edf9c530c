"""Readers for tabular text, sequences, alignments, probability bands and settings."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from dataclasses import fields, is_dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions.nulls import strict_number
from ..operators.quality import assert_columns


def _strings(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def _filled(df: DataFrame) -> DataFrame:
    """Empty cells as ""; the reader gives NULL for them."""
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def read_tsv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, sep: str = "\t", quote: str = '"') -> DataFrame:
    """Delimited text with a header, every cell a string, empty cells kept as "".

    ``columns`` is the exact ordered header; another header raises. gzip is
    read too, one task per file.
    """
    # only the header line reaches the driver
    header = spark.read.option("wholetext", False).text(path).limit(1).collect()
    if not header or not header[0][0]:
        raise ValueError(f"no header in {path}")
    names = [c.strip(quote) for c in header[0][0].split(sep)]
    df = spark.read.schema(_strings(names)).csv(path, sep=sep, header=True, quote=quote, nullValue="\0", emptyValue="", enforceSchema=False)
    return assert_columns(_filled(df), exact=columns or ())


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    return read_tsv(spark, path, columns, sep=",")


def read_sample_tables(spark: SparkSession, root: str, samples: Sequence[str], columns: Sequence[str], name: str = "*.tsv.gz") -> DataFrame:
    """Per-sample gzip tables ``root/<sample>/<name>``; only the folders of the wanted samples are opened."""
    paths = [f"{root}/{s}/{name}" for s in sorted(samples)]
    return _filled(spark.read.schema(_strings(columns)).csv(paths, sep="\t", header=True, nullValue="\0", emptyValue="", mode="FAILFAST", enforceSchema=False))


def read_fasta(spark: SparkSession, path: str, rna: bool | None = None, unique: bool = False) -> DataFrame:
    """(path, id, header, sequence) of FASTA records, upper case, lines joined.

    ``rna=False`` writes T for U, ``rna=True`` U for T. Text before the first
    header or a record without letters raises; with ``unique`` so does an id
    that occurs twice.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.input_file_name().alias("path"), F.col("value"))
    # split records lose their ">" except the first of a file; without such a record, or a blank one, a file begins otherwise
    begins = raw.groupBy("path").agg(F.max(F.col("value").startswith(">") | (F.trim(F.regexp_replace("value", r"\s", "")) == "")).alias("ok"))
    if begins.filter("not ok").limit(1).count():
        raise ValueError(f"text before the first FASTA header in {path}")
    head = F.substring_index(F.regexp_replace(F.col("value"), "^>", ""), "\n", 1)
    seq = F.upper(F.regexp_replace(F.expr("substring(value, length(substring_index(value, '\n', 1)) + 1)"), r"\s", ""))
    if rna is not None:
        seq = F.translate(seq, "T", "U") if rna else F.translate(seq, "U", "T")
    out = raw.filter(F.length(F.trim("value")) > 0).select("path", F.trim(head).alias("header"), seq.alias("sequence"))
    bad = (F.length("header") == 0) | (F.length("sequence") == 0)
    out = out.withColumn("sequence", F.when(~bad, F.col("sequence")).otherwise(F.raise_error(F.lit("malformed FASTA record")).cast("string")))
    out = out.select("path", F.substring_index("header", " ", 1).alias("id"), "header", "sequence")
    if unique:
        n = F.count(F.lit(1)).over(W.partitionBy("path", "id"))
        out = out.withColumn("id", F.when(n == 1, F.col("id")).otherwise(F.raise_error(F.lit("duplicate FASTA id")).cast("string")))
    return out


#: Bits of the SAM flag (fixed values).
UNMAPPED, REVERSE, SUPPLEMENTARY = 0x4, 0x10, 0x800


def read_sam_header(spark: SparkSession, path: str) -> DataFrame:
    """(contig, contig_length) from the @SQ lines."""
    tags = F.str_to_map(F.expr("substring(value, 5)"), F.lit("\t"), F.lit(":"))
    sq = spark.read.text(path).filter(F.col("value").startswith("@SQ\t")).select(tags.alias("t"))
    return sq.select(F.try_element_at("t", F.lit("SN")).alias("contig"), F.try_element_at("t", F.lit("LN")).cast("long").alias("contig_length"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment records: read, flag, contig, 0-based start, cigar, edit distance, strand, mapped, supplementary."""
    cols = F.split("value", "\t")
    rec = spark.read.text(path).filter(~F.col("value").startswith("@") & (F.length("value") > 0)).select(cols.alias("c"))
    flag = F.col("c")[1].cast("int")
    tags = F.filter(F.slice("c", 12, 1000), lambda t: t.startswith("NM:i:"))
    return rec.select(
        F.col("c")[0].alias("read_name"), flag.alias("flag"), F.col("c")[2].alias("contig"), (F.col("c")[3].cast("long") - 1).alias("start"),
        F.col("c")[5].alias("cigar"), F.substring(F.get(tags, F.lit(0)), 6, 10).cast("int").alias("edit_distance"),
        F.when(flag.bitwiseAND(REVERSE) != 0, "antisense").otherwise("sense").alias("strand"),
        (flag.bitwiseAND(UNMAPPED) == 0).alias("mapped"), (flag.bitwiseAND(SUPPLEMENTARY) != 0).alias("supplementary"),
    )


def read_sam_unchecked(spark: SparkSession, path: str) -> DataFrame:
    """Every record line as it is, for ``plans.validation``: n_fields, flag, contig, position (1-based), cigar, tags.

    Numbers that are none, and fields a line lacks, are NULL. Lines that begin with @ are header lines, as a read's name cannot.
    """
    cols = F.split("value", "\t")
    rec = spark.read.text(path).filter(~F.col("value").startswith("@")).select(cols.alias("c"))
    get = lambda i: F.get("c", F.lit(i))
    return rec.select(
        F.size("c").alias("n_fields"), get(1).try_cast("int").alias("flag"), get(2).alias("contig"), get(3).try_cast("long").alias("position"),
        get(5).alias("cigar"), F.filter("c", lambda t, i: i >= 11).alias("tags"),
    )


def read_sam_programs(spark: SparkSession, path: str) -> DataFrame:
    """(line) of the @PG lines."""
    return spark.read.text(path).filter(F.col("value").startswith("@PG\t")).select(F.col("value").alias("line"))


def sam_loci(records: DataFrame, reads: DataFrame) -> DataFrame:
    """Distinct loci of known reads: mapped, primary, on a contig of the read's unit, on the read's strand.

    ``reads`` has read_name, unit and strand. The unit is the contig's text before the first bar.
    """
    hits = records.filter(F.col("mapped") & ~F.col("supplementary")).withColumn("unit", F.substring_index("contig", "|", 1))
    return hits.join(reads.select("read_name", "unit", "strand"), ["read_name", "unit", "strand"], "left_semi").select("read_name", "unit", "strand", "contig", "start", "cigar").dropDuplicates()


def read_probability_bands(spark: SparkSession, path: str) -> DataFrame:
    """(end, length, p) from a banded text matrix: end, then p of the interval of length 1, 2, ...; NA cells are left out."""
    cells = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(F.trim("value").rlike(r"^\d")).select(cells.alias("c"))
    long = rows.select(F.col("c")[0].cast("int").alias("end"), F.posexplode(F.slice("c", F.lit(2), F.greatest(F.size("c") - 1, F.lit(1)))).alias("i", "text"))
    return long.filter(F.col("text") != "NA").select("end", (F.col("i") + 1).cast("int").alias("length"), strict_number("text", 0, 1).alias("p"))


#: Columns of distances between focal and passenger reads, one row a pair of a run (fixed values).
DISTANCES = ["run", "focal_id", "passenger_id", "d5", "d3", "passenger_length"]


def read_distances(spark: SparkSession, path: str) -> DataFrame:
    """Distances taken from an alignment elsewhere, as there is no source for its binary form: run, ids, both end distances, length.

    Distances that are no whole numbers, a length below 1, or a pair that a run holds twice raise.
    """
    df = read_tsv(spark, path, DISTANCES)
    number = {c: F.col(c).try_cast("int") for c in DISTANCES[3:]}
    n = F.count(F.lit(1)).over(W.partitionBy(*DISTANCES[:3]))
    ok = number["d5"].isNotNull() & number["d3"].isNotNull() & F.coalesce(number["passenger_length"] >= 1, F.lit(False)) & (n == 1)
    checked = df.withColumn("run", F.when(ok, F.col("run")).otherwise(F.raise_error(F.lit("bad or repeated distance")).cast("string")))
    return checked.select(*DISTANCES[:3], *[c.alias(k) for k, c in number.items()])


def fold_targets(df: DataFrame, fold, key: str = "id", sequence: str = "sequence") -> DataFrame:
    """(key, sequence, structure, energy) by a function from a sequence to (structure, energy), for which any folding program can stand.

    A structure of another length raises. NULL sequences give NULLs.
    """
    kind = dict(df.dtypes)[key]

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = [fold(s) if s is not None else (None, None) for s in b["sequence"]]
            if bad := [s for s, (x, _) in zip(b["sequence"], rows, strict=True) if s is not None and len(x) != len(s)]:
                raise ValueError(f"structure of another length than {bad[0]}")
            yield pd.DataFrame({"key": b["key"], "sequence": b["sequence"], "structure": [x for x, _ in rows], "energy": [e for _, e in rows]})

    out = df.select(F.col(key).alias("key"), F.col(sequence).alias("sequence")).mapInPandas(run, f"key {kind}, sequence string, structure string, energy double")
    return out.withColumnRenamed("key", key)


def read_fold_records(spark: SparkSession, path: str) -> DataFrame:
    """(id, sequence, structure, energy) from three-line fold output."""
    recs = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("v")).filter(F.length(F.trim("v")) > 0)
    pattern = r"^(\S+)[^\n]*\n([ACGUTacgut]+)\s*\n([.()]+)\s+\(\s*(-?\d+(?:\.\d+)?)\)\s*$"
    got = recs.select(*[F.regexp_extract(F.trim("v"), pattern, i).alias(n) for i, n in enumerate(["id", "sequence", "structure", "energy"], 1)])
    ok = (F.length("id") > 0) & (F.length("sequence") == F.length("structure"))
    return got.withColumn("energy", F.when(ok, F.col("energy").try_cast("double")).otherwise(F.raise_error(F.lit("malformed fold record")).cast("double")))


def read_settings(path: str, cls: type, expected: dict | None = None):
    """A frozen dataclass from a JSON file: its fields must be present; ``expected`` values must be met."""
    assert is_dataclass(cls)
    with open(path) as f:
        data = json.load(f)
    names = [x.name for x in fields(cls)]
    if missing := [n for n in names if n not in data]:
        raise ValueError(f"settings missing: {missing}")
    for k, v in (expected or {}).items():
        if data.get(k) != v:
            raise ValueError(f"setting {k} must be {v!r}, is {data.get(k)!r}")
    return cls(**{n: tuple(data[n]) if isinstance(data[n], list) else data[n] for n in names})


def read_stack_parameters(spark: SparkSession, path: str, id_col: str = "parameter_id", value_col: str = "delta_g37_kcal_mol", type_col: str = "parameter_type") -> tuple[dict, dict]:
    """Stack energies and end corrections; all 16 stacks are needed and a stack equals its reverse complement."""
    rows = read_tsv(spark, path).select(type_col, id_col, strict_number(value_col).alias("v")).limit(1000).collect()
    stacks = {r[1]: r["v"] for r in rows if r[0] == "stack"}
    letters = "ACGU"
    if sorted(stacks) != sorted(a + b for a in letters for b in letters):
        raise ValueError("the table must hold the 16 stacks")
    flip = str.maketrans(letters, letters[::-1])
    for s, v in stacks.items():
        if stacks[s[::-1].translate(flip)] != v:
            raise ValueError(f"stack {s} differs from its reverse complement")
    ends = {r[1]: r["v"] for r in rows if r[0] == "end_correction"}
    correction = {pair: next((v for k, v in ends.items() if f"on_{pair}" in k), None) for pair in ("AU", "GC")}
    if absent := [pair for pair, v in correction.items() if v is None]:
        raise ValueError(f"end corrections missing: {absent}")
    return stacks, correction


def resolve_path(path: str, manifest: str) -> str:
    """A registered path: as given if it exists, else relative to the manifest's folder."""
    if os.path.exists(path):
        return path
    beside = os.path.join(os.path.dirname(os.path.abspath(manifest)), path)
    if os.path.exists(beside):
        return beside
    raise FileNotFoundError(path)


def read_registry(spark: SparkSession, path: str, columns: Sequence[str], key: str) -> DataFrame:
    """A registry table whose key must be unique."""
    df = read_tsv(spark, path, columns)
    n = F.count(F.lit(1)).over(W.partitionBy(key))
    return df.withColumn(key, F.when(n == 1, F.col(key)).otherwise(F.raise_error(F.lit("duplicate registry key")).cast("string")))


def read_intervals(spark: SparkSession, path: str, columns: Sequence[str], start: str, end: str, key: str) -> DataFrame:
    """1-based inclusive intervals; a reversed or overlapping one raises."""
    df = read_tsv(spark, path, columns).withColumn(start, F.col(start).cast("int")).withColumn(end, F.col(end).cast("int"))
    before = F.max(end).over(W.partitionBy(key).orderBy(start, end).rowsBetween(W.unboundedPreceding, -1))
    ok = (F.col(start) >= 1) & (F.col(start) <= F.col(end)) & (F.col(start) > F.coalesce(before, F.lit(0)))
    return df.withColumn(start, F.when(ok, F.col(start)).otherwise(F.raise_error(F.lit("bad interval")).cast("int")))


def interval_status(intervals: DataFrame, targets: DataFrame, key: str, start: str, end: str, length: str) -> DataFrame:
    """unavailable, partial or complete: how far a target's intervals cover it."""
    covered = intervals.groupBy(key).agg(F.sum(F.col(end) - F.col(start) + 1).alias("_n"))
    state = F.when(F.col("_n").isNull(), "unavailable").when(F.col("_n") == F.col(length), "complete").otherwise("partial")
    return targets.join(covered, key, "left").withColumn("annotation_status", state).drop("_n")


def read_with_digest(spark: SparkSession, path: str) -> DataFrame:
    """File contents beside their SHA-256, from one read."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("content").cast("string").alias("text"))

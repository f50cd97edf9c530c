import hashlib

import pytest

from corvane.plans import validation as V
from corvane.sources import readers

PROGRAM = V.program_pattern("mapper", "1.3.1", "-v 0")
SQ = "@SQ\tSN:u|s\tLN:50\n"
PG = "@PG\tID:mapper\tVN:1.3.1\tCL:mapper -v 0 x\n"


def record(flag="0", contig="u|s", pos="11", cigar="3M", tag="NM:i:0"):
    return f"r\t{flag}\t{contig}\t{pos}\t60\t{cigar}\t*\t0\t0\tACG\tIII\t{tag}\n"


def judge(spark, tmp_path, text, reference=(("s", "u|s", 50),)):
    from pyspark.sql import functions as F

    path = tmp_path / "a.sam"
    path.write_text(text)
    scoped = lambda df: df.withColumn("sample", F.lit("s"))
    ref = spark.createDataFrame(list(reference), "sample string, contig string, contig_length long")
    p = str(path)
    rows = V.alignment_checks(scoped(readers.read_sam_unchecked(spark, p)), scoped(readers.read_sam_header(spark, p)), ref, scoped(readers.read_sam_programs(spark, p)), "sample", PROGRAM).collect()
    assert len(rows) == 1
    return rows[0]["status"], rows[0]["observed"], rows[0]["faults"]


@pytest.mark.parametrize(
    "text, faults",
    [
        (SQ + PG + record() + record(pos="48"), ""),
        (SQ + PG + record(pos="48", cigar="2M1D1M"), "bounds=1"),
        (SQ + PG + record(pos="0"), "bounds=1"),
        (SQ + PG + record(cigar="3S"), "bounds=1"),
        (SQ + PG + record(cigar="*") + record(cigar="3Q"), "cigar=2"),
        (SQ + PG + record(cigar="9" * 30 + "M"), "cigar=1"),
        (SQ + PG + record(flag="4") + record(contig="v"), "unmapped=1; contig=1"),
        (SQ + PG + record(tag="NM:i:1") + record(tag="XM:i:1"), "edit_distance=1"),
        (SQ + PG + "r\t0\tu|s\n" + record(flag="x"), "fields=1; numbers=1"),
        (SQ + SQ + PG + record(), "header=1"),
        ("@SQ\tSN:u|s\tLN:60\n" + PG + record(), "dictionary=2"),
        (SQ + PG.replace("-v 0", "-v 01") + record(), "program=1"),
        (SQ + PG.replace("1.3.1", "1.3.10") + record(), "program=1"),
    ],
)
def test_alignments(spark, tmp_path, text, faults):
    status, _, got = judge(spark, tmp_path, text)
    assert (status, got) == ("FAIL" if faults else "PASS", faults)


def test_alignments_of_an_empty_file(spark, tmp_path):
    assert judge(spark, tmp_path, "") == ("FAIL", 0, "dictionary=1; program=1")


def test_features(spark):
    rows = spark.createDataFrame(
        [
            ("s", "a", "ACG", 3, 1, 1, True, True),
            ("s", "a", "ACG", 4, 1, 1, True, True),  # length
            ("s", "b", "ACG", 3, -1, 1, True, False),  # numbers, and b is not eligible
            ("s", "c", None, None, 1, 1, None, None),  # numbers
            ("t", "a", "", 0, 0, 0, True, False),  # lacking: never exact
        ],
        "sample string, unit string, sequence string, length int, count int, loci int, assigned boolean, exact boolean",
    )
    eligible = spark.createDataFrame([("s", "a"), ("t", "a"), ("t", "a")], "sample string, unit string")
    positive = spark.createDataFrame([("s", "a"), ("t", "a"), ("w", "a")], "sample string, unit string")
    got = {r["scope"]: (r["observed"], r["faults"]) for r in V.feature_checks(rows, eligible, positive, "sample", "unit").collect()}
    assert got == {"s": (4, "numbers=2; length=1; pair=1"), "t": (1, "lacking=1"), "w": (0, "lacking=1")}
    assert V.feature_checks(rows.limit(0), eligible, positive.limit(0), "sample", "unit").count() == 0


def _seq(spark, rows):
    return spark.createDataFrame(rows, "sample string, unit string, id string, sequence string")


def test_sequences(spark):
    final = _seq(spark, [("s", "u", "u|1", "ACGT"), ("s", "u", "u|2", "AAAA"), ("s", "v", "u|3", "CC"), ("s", "w", "w|1", "GG")])
    background = _seq(spark, [("s", "u", "u|1", "ANGT"), ("s", "u", "u|2", "AACA"), ("s", "v", "u|3", "CC"), ("s", "w", "w|1", "GGG")])
    whole = spark.createDataFrame([("s", "u|1", "ACGT"), ("s", "u|2", "AAAT"), ("s", "w|1", "GG"), ("s", "w|2", "GG")], "sample string, id string, sequence string")
    eligible = spark.createDataFrame(
        [("s", "u", 8, 8, 7), ("s", "v", 2, 2, 3), ("s", "w", 2, 2, 2), ("s", "x", 0, 0, None)],
        "sample string, unit string, reference_length int, background_total int, background_usable int",
    )
    got = {r["scope"]: r["faults"] for r in V.sequence_checks(final, background, whole, eligible, "sample", "unit").collect()}
    assert got == {
        "s:u": "whole_sequence=1; substitution=1",
        "s:v": "owner=1; whole_ids=1; background_usable=1",
        "s:w": "whole_ids=1; background_length=1; background_total=1; background_usable=1",
        "s:x": "background_usable=1",
    }


def test_sets_totals_and_states(spark):
    pairs = lambda *x: spark.createDataFrame(list(x), "sample string, unit string")
    found, wanted = pairs(("s", "a"), ("s", "a"), ("s", "z"), (None, "a")), pairs(("s", "a"), ("s", "b"), (None, "a"))
    got = V.same_keys("manifest", found, wanted, ["sample", "unit"]).first()
    assert (got["status"], got["observed"], got["faults"]) == ("FAIL", 4, "missing=1; unexpected=1; repeated=1")
    by = {r["scope"]: r["faults"] for r in V.same_keys("m", found, wanted, ["sample", "unit"], "sample").collect()}
    assert by == {"s": "missing=1; unexpected=1; repeated=1", None: ""}
    assert V.same_keys("m", found.limit(0), wanted.limit(0), ["sample"]).first()["status"] == "PASS"
    assert V.owned_by("catalogue", found, wanted, ["sample", "unit"]).first()["faults"] == "conflicts=2"
    assert V.row_total("rows", found, 6).first()["faults"] == "difference=2"
    assert V.all_in_state("audit", found, "unit", "a").first()["faults"] == "other=1"
    assert V.all_in_state("audit", found.limit(0), "unit", "a").first()["faults"] == "empty=1"
    cats = V.category_rows(found, "sample", ["unit"]).filter("scope = 's'").first()
    assert (cats["check"], cats["status"], cats["observed"], cats["faults"]) == ("categories_unit", "INFO", 2, "a,z")
    ledger = V.composite(V.row_total("rows", found, 4), V.row_total("rows", found, 6), V.category_rows(found, "sample", ["unit"]))
    assert V.verdict(ledger).first().asDict() == {"n_pass": 1, "n_warn": 0, "n_fail": 1, "n_info": 2, "status": "FAIL"}


def test_files(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"x" * 10)
    (tmp_path / "b").write_bytes(b"")
    paths = [str(tmp_path / n) for n in "abc"]
    ids = V.file_identities(spark, [*paths, paths[0]], block=3)
    assert {r["path"]: (r["size"], r["sha256"]) for r in ids.collect()}[paths[0]] == (10, hashlib.sha256(b"x" * 10).hexdigest())
    got = {r["scope"]: (r["status"], r["faults"]) for r in V.file_checks(ids).collect()}
    assert got == {paths[0]: ("PASS", ""), paths[1]: ("FAIL", "empty=1"), paths[2]: ("FAIL", "unreadable=1")}
    assert V.outside("output", spark, [str(tmp_path / "o")], str(tmp_path)).first()["faults"] == "inside=1"
    assert V.outside("output", spark, ["/o"], str(tmp_path)).first()["status"] == "PASS"

import gzip
import hashlib
import json
from dataclasses import dataclass

import pytest

from corvane.operators import quality
from corvane.sources import readers


def put(path, text):
    path.write_text(text)
    return str(path)


def test_csv_keeps_quoted_commas(spark, tmp_path):
    p = put(tmp_path / "a.csv", 'x,y\n1,"a,b"\n2,\n')
    assert [tuple(r) for r in readers.read_csv(spark, p, ["x", "y"]).orderBy("x").collect()] == [("1", "a,b"), ("2", "")]
    with pytest.raises(ValueError, match="are not"):
        readers.read_csv(spark, p, ["y", "x"])


def test_sample_tables_open_only_wanted_samples(spark, tmp_path):
    for s in ("s1", "s2", "s3"):
        (tmp_path / s).mkdir()
        with gzip.open(tmp_path / s / "r.tsv.gz", "wt") as f:
            f.write(f"sample\tn\n{s}\t1\n{s}\t\n")
    got = [tuple(r) for r in readers.read_sample_tables(spark, str(tmp_path), ["s3", "s1"], ["sample", "n"]).orderBy("sample", "n").collect()]
    assert got == [("s1", ""), ("s1", "1"), ("s3", ""), ("s3", "1")]
    (tmp_path / "s1" / "r.tsv.gz").write_bytes(b"\x1f\x8bbroken")
    with pytest.raises(Exception):
        readers.read_sample_tables(spark, str(tmp_path), ["s1"], ["sample", "n"]).collect()


def test_fold_records(spark, tmp_path):
    p = put(tmp_path / "f.txt", ">a one\nACGU\n(..) ( -1.20)\n>b\nAC\n.. (0.00)\n")
    got = {r["id"]: (r["sequence"], r["structure"], r["energy"]) for r in readers.read_fold_records(spark, p).collect()}
    assert got == {"a": ("ACGU", "(..)", -1.2), "b": ("AC", "..", 0.0)}
    with pytest.raises(Exception, match="malformed fold record"):
        readers.read_fold_records(spark, put(tmp_path / "g.txt", ">a\nACGU\n(.) (-1.0)\n")).collect()


@dataclass(frozen=True)
class Settings:
    seed: int
    lengths: tuple


def test_settings(tmp_path):
    p = put(tmp_path / "s.json", json.dumps({"seed": 7, "lengths": [23, 24], "other": 1}))
    assert readers.read_settings(p, Settings, {"seed": 7}) == Settings(7, (23, 24))
    with pytest.raises(ValueError, match="must be 8"):
        readers.read_settings(p, Settings, {"seed": 8})
    with pytest.raises(ValueError, match="missing"):
        readers.read_settings(put(tmp_path / "t.json", "{}"), Settings)


def test_registry_and_its_paths(spark, tmp_path):
    p = put(tmp_path / "m.tsv", "id\tpath\na\tx.fa\nb\ty.fa\n")
    put(tmp_path / "x.fa", ">x\nA\n")
    assert readers.read_registry(spark, p, ["id", "path"], "id").count() == 2
    assert readers.resolve_path("x.fa", p) == str(tmp_path / "x.fa")
    with pytest.raises(FileNotFoundError):
        readers.resolve_path("y.fa", p)
    with pytest.raises(Exception, match="duplicate registry key"):
        readers.read_registry(spark, put(tmp_path / "n.tsv", "id\tpath\na\tx\na\ty\n"), ["id", "path"], "id").collect()


def test_intervals_and_status(spark, tmp_path):
    head = ["target", "first", "last"]
    p = put(tmp_path / "i.tsv", "\t".join(head) + "\na\t1\t4\na\t5\t10\nb\t2\t3\n")
    iv = readers.read_intervals(spark, p, head, "first", "last", "target")
    targets = spark.createDataFrame([("a", 10), ("b", 10), ("c", 10)], "target string, n int")
    got = {r["target"]: r["annotation_status"] for r in readers.interval_status(iv, targets, "target", "first", "last", "n").collect()}
    assert got == {"a": "complete", "b": "partial", "c": "unavailable"}
    for i, rows in enumerate(["a\t1\t4\na\t4\t9", "a\t5\t4", "a\t0\t4", "a\tx\t4"]):
        with pytest.raises(Exception):
            readers.read_intervals(spark, put(tmp_path / f"bad{i}.tsv", "\t".join(head) + f"\n{rows}\n"), head, "first", "last", "target").collect()


def test_content_with_digest(spark, tmp_path):
    r = readers.read_with_digest(spark, put(tmp_path / "a.json", '{"k": 1}')).first()
    assert (r["text"], r["sha256"]) == ('{"k": 1}', hashlib.sha256(b'{"k": 1}').hexdigest())


def test_enumeration_invariants(spark):
    targets = spark.createDataFrame([("t", "ACGT"), ("u", "ACG")], "id string, seq string")
    good = [("t", 3, 1, "ACG"), ("t", 3, 2, "CGT"), ("u", 3, 1, "ACG")]
    spec = "id string, k int, start int, w string"
    assert quality.enumeration_invariants(spark.createDataFrame(good, spec), targets, "id", "seq", "k", "start", "w").count() == 0
    for bad in (good[1:], [*good[:2], ("u", 3, 1, "ACC")], [good[0], ("t", 3, 3, "GT"), good[2]]):
        assert quality.enumeration_invariants(spark.createDataFrame(bad, spec), targets, "id", "seq", "k", "start", "w").count() == 1


def test_masks_identities_and_leaks(spark):
    masks = spark.createDataFrame([("ACGT", "ANGN"), ("ACGT", "ACCT"), ("ACGT", "ACG")], "o string, m string")
    assert sorted(r["m"] for r in quality.mask_faults(masks, "o", "m").collect()) == ["ACCT", "ACG"]
    digest = hashlib.sha256(b"ACG").hexdigest()
    ids = spark.createDataFrame([("ACG", "3", digest.upper()), ("ACG", "4", digest), ("ACC", "3", digest)], "s string, n string, d string")
    assert quality.identity_faults(ids, "s", "n", "d").count() == 2
    train, held = (spark.createDataFrame([(x,) for x in v], "g string") for v in (["a", "b", "b"], ["b", "c"]))
    assert [r["g"] for r in quality.leakage(train, held, ["g"]).collect()] == ["b"]


def test_files_and_failures(spark, tmp_path):
    full, empty = put(tmp_path / "a", "x"), put(tmp_path / "b", "")
    assert quality.required_files([full, empty, str(tmp_path / "c")]) == [empty, str(tmp_path / "c")]
    (tmp_path / "link").symlink_to(tmp_path / "a")
    assert quality.is_within(str(tmp_path / "link"), str(tmp_path)) and not quality.is_within(str(tmp_path) + "x", str(tmp_path))
    with quality.Unchanged([full]):
        pass
    with pytest.raises(RuntimeError, match="inputs changed"), quality.Unchanged([full]):
        put(tmp_path / "a", "y")

    def fails():
        raise ValueError("no such table")

    row = quality.guarded(spark, "stage", fails).first()
    assert tuple(row) == ("stage", "FAIL", "ValueError", "no such table")

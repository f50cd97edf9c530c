from corvane.operators import pareto, ranking, statistics
from corvane.sources import readers, sinks


def put(path, text):
    path.write_text(text)
    return str(path)


def test_tsv_and_single_sink(spark, tmp_path):
    p = put(tmp_path / "a.tsv", "x\ty\n1\t\n2\tNA\n")
    df = readers.read_tsv(spark, p, ["x", "y"])
    assert [tuple(r) for r in df.orderBy("x").collect()] == [("1", ""), ("2", "NA")]
    out = str(tmp_path / "o.tsv")
    sinks.write_single_tsv(spark.createDataFrame([("a", 1.0, None), ("b", 0.1, 2)], "k string, v double, n int"), out, order=["k"])
    assert open(out).read() == "k\tv\tn\na\t1\tNA\nb\t0.1\t2\n"


def test_fasta(spark, tmp_path):
    p = put(tmp_path / "a.fa", ">one first\nACG\nu\n>two\nNNA\n")
    got = {r["id"]: r["sequence"] for r in readers.read_fasta(spark, p, rna=False).collect()}
    assert got == {"one": "ACGT", "two": "NNA"}


def test_sam_loci(spark, tmp_path):
    rec = "r1\t0\tu|s\t11\t60\t3M\t*\t0\t0\tACG\tIII\tNM:i:0\n"
    p = put(tmp_path / "a.sam", "@SQ\tSN:u|s\tLN:50\n" + rec + rec + rec.replace("r1\t0", "r1\t16"))
    reads = spark.createDataFrame([("r1", "u", "sense")], "read_name string, unit string, strand string")
    assert readers.read_sam_header(spark, p).collect()[0]["contig_length"] == 50
    got = readers.sam_loci(readers.read_sam(spark, p), reads).collect()
    assert len(got) == 1 and got[0]["start"] == 10


def test_bands(spark, tmp_path):
    p = put(tmp_path / "p.txt", "#i l=1 2\n1\t0.5\tNA\n2\t0.25\t0.125\n")
    assert {tuple(r) for r in readers.read_probability_bands(spark, p).collect()} == {(1, 1, 0.5), (2, 1, 0.25), (2, 2, 0.125)}


def test_ranks_and_corrections(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 2, 4])], "i int, v double")
    got = ranking.favourable_percentile(df, [], "v", "p").orderBy("i").collect()
    assert [r["p"] for r in got] == [0.125, 0.5, 0.5, 0.875]
    p = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03), (3, None)], "i int, p double")
    q = [r["q"] for r in statistics.adjust_p(p, [], "p", "q").orderBy("i").collect()]
    assert [None if x is None else round(x, 9) for x in q] == [0.03, 0.04, 0.04, None]


def test_fronts():
    assert pareto.front_numbers([(3, 3, 3), (2, 3, 3), (3, 2, 3), (1, 1, 1)]) == [1, 2, 2, 3]

"""The registered queries against their SQL, and the corpus pipeline against a brute-force version."""

import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from corvane.llm import catalog, mixing, quality_classifier

from ..oracle import compare, connect

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(D), catalog.QUERIES[name], catalog.ORACLE[name], D) == ""


def _folder(spark, tmp_path, change=lambda df: df):
    """The smallest documents, changed, beside the given labels."""
    for name in ("documents", "labels"):
        df = spark.read.parquet(f"{D}/{name}.parquet")
        (change(df) if name == "documents" else df).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def _brute_stages(spark, rows, d):
    """Rows (doc_id, text, lang, source, ...) that each stage keeps, by plain Python over all of them."""
    import sentencepiece

    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = catalog.quality_model(docs, spark, d)
    import numpy as np

    flags = np.zeros(quality_classifier.SIZE, bool)

    def score(text):
        if "constant" in model:
            return model["constant"]
        return 1 / (1 + float(np.exp(-np.clip(model["slope"] * quality_classifier.margin(model, quality_classifier.features(text, flags)) + model["shift"], -30, 30))))

    rows = [r for r in rows if score(r["text"]) >= 0.3]
    yield rows
    best = {}
    for r in rows:
        best[_lower(r["text"])] = max(best.get(_lower(r["text"]), -1), r["doc_id"])
    rows = [r for r in rows if best[_lower(r["text"])] == r["doc_id"]]
    yield rows
    sets = {}
    for r in rows:
        w = _lower(r["text"]).split()
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    rows = [r for r in rows if not sets[r["doc_id"]] or find(r["doc_id"]) == r["doc_id"]]
    yield rows
    con = duckdb.connect()
    frame = spark.createDataFrame(rows, docs.schema).toPandas()  # noqa: F841
    con.execute("create view documents as select * from frame")
    taken = {i: t // s if s else 0 for i, s, t in con.execute(f"select doc_id, size, taken from ({catalog.MIX_SQL})").fetchall()}
    rows = [r for r in rows for _ in range(taken[r["doc_id"]])]
    yield rows
    sp = sentencepiece.SentencePieceProcessor(model_file=catalog.vocabulary("piece_bpe_32k.model"))
    yield [(r["doc_id"], tuple(sp.encode(r["text"] or ""))) for r in rows]


def test_pipeline_equals_brute_force(spark, tmp_path):
    """All stages of the whole pipeline over all documents of the smallest tables, with NULL, empty and repeated texts among them."""
    import corpus_pipeline

    def change(df):
        more = df.limit(3).withColumn("doc_id", F.col("doc_id") + 100_000)
        odd = df.limit(2).withColumn("doc_id", F.col("doc_id") + 200_000).withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.lit("")))
        return df.unionByName(more).unionByName(odd).withColumn("score", F.lit(1)).withColumn("_id", F.lit("x"))

    d = _folder(spark, tmp_path, change)
    rows = spark.read.parquet(f"{d}/documents.parquet").collect()
    want = _brute_stages(spark, rows, d)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for i, ((name, stage), expected) in enumerate(zip(corpus_pipeline.STAGES, want, strict=True)):
        path = str(tmp_path / f"stage{i}")
        out = stage(spark, docs, d)
        if i < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        got = docs.collect()
        if i < 4:
            assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in expected), name
            assert sorted(map(repr, got)) == sorted(map(repr, expected)), name
        else:
            assert sorted((r["doc_id"], tuple(r["ids"])) for r in got) == sorted(expected)
    run = corpus_pipeline.run(spark, d)
    assert sorted((r["doc_id"], tuple(r["ids"])) for r in run.collect()) == sorted((r["doc_id"], tuple(r["ids"])) for r in got)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    d = _folder(spark, tmp_path, lambda df: df.limit(0))
    assert corpus_pipeline.run(spark, d).count() == 0


def test_mixing_sql_words_are_the_operators(spark):
    """The size that SQL and operator count on odd white space."""
    df = spark.createDataFrame([(1, "a b  c\td\x0be\x0cf", "s"), (2, None, None)], "doc_id long, text string, source string")
    assert [r["_size"] for r in mixing.sizes(df).orderBy("_id").collect()] == [5, 0]

import hashlib
import random
import zlib

import pytest

from corvane.llm import prefix_trie
from corvane.operators.scan import numbered
from pyspark.sql import functions as F

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, words string, fam string"


def brute_force(rows):
    """Every rebuilt conversation as a tuple of turns, every prefix as a node, subtrees by looking at all nodes."""
    turns = {}
    for c, t, role, text, *_ in rows:
        turns.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4 if c is not None else 0
        base = int(c / 20) * 20 if c is not None else None
        built[c] = tuple((turns.get(base, []) if c is not None else [])[:h] + own[h:])
    members, ends = {(): []}, {}
    for c, path in built.items():
        ends.setdefault(path, []).append(c)
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    if not built:
        return []
    ids = lambda x: sorted(c for c in x if c is not None)
    least = lambda x: min(ids(x), default=None)
    words = lambda p: len(p[-1][1].split()) if p else 0
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        children = sum(len(q) == len(p) + 1 for q in below)
        leaves = sum(not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in below) for q in below)
        digest = hashlib.sha256(",".join(map(str, ids(ends.get(p, [])))).encode()).hexdigest()
        out.append((least(m), len(p), least(members[p[:-1]]) if p else None, len(m), children, leaves, sum((len(members[q]) - 1) * words(q) for q in below), digest))
    return sorted(out, key=str)


def corpus(seed):
    """Families with shared beginnings, absent bases, conversations shorter than their head, equal ones and odd ids."""
    rng = random.Random(seed)
    rows = []
    for c in [*rng.sample(range(130), 70), -7, -3, -25, 100_000_000_007]:
        for t in range(rng.choice([0, 1, 1, 2, 3, 4, 6])):
            rows.append((c, t * 3 - 2, rng.choice(["user", "assistant"]), rng.choice(["a", "b b", "hello  there you"]), "x", "y"))
    rows += [(41, None, None, None, "x", "y"), (41, 1, "user", "a", "x", "y"), (41, 1, "user", "a", "x", "y"), (41, 1, "assistant", "a", "x", "y"), (None, 2, "user", "a", "x", "y"), (None, 1, None, "b b", "x", "y"), (60, 1, "user", "long " * 60_000, "x", "y")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("most", [prefix_trie.FAMILY_TURNS, 0, 12])
def test_trie_equals_brute_force(spark, most):
    """Small families, all families by scans, and both."""
    rows = corpus(most)
    got = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(3), family_turns=most)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == brute_force(rows)


def test_trie_of_an_empty_table(spark):
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_many_ends_of_one_node(spark, monkeypatch):
    """Ids of one node are joined in pieces, over several partitions."""
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 7)
    ids = spark.range(0, 1000, 1, 5).select(F.lit(1).cast("long").alias("i1"), F.lit(2).cast("long").alias("i2"), (F.col("id") - 500).alias("conv"))
    (row,) = prefix_trie.ends_digests(ids).collect()
    assert row["ends_sha256"] == hashlib.sha256(",".join(map(str, range(-500, 500))).encode()).hexdigest()


def test_a_conversation_of_many_turns(spark):
    """A family larger than a task may hold: a chain of nodes with one leaf."""
    n = 30_000
    turns = spark.range(n).select(F.lit(20).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("w "), F.col("id").cast("string")).alias("text"), F.lit("").alias("words"), F.lit("").alias("fam"))
    got = prefix_trie.trie(turns, family_turns=1000)
    assert got.agg(F.count(F.lit(1)), F.max("depth"), F.sum("n_leaves"), F.sum("n_children"), F.sum("saved_tokens"), F.max("n_convs")).first() == (n + 1, n, n + 1, n, 0, 1)


def test_numbered_rows_of_one_key(spark):
    rows = numbered(spark.range(5000).withColumn("k", F.lit(None).cast("string")), ["k"], [F.col("id").desc()], {"id": "total"}, partitions=7).collect()
    assert all(r["_row"] == 5000 - r["id"] and r["total"] == sum(range(r["id"], 5000)) for r in rows[:50]) and len(rows) == 5000

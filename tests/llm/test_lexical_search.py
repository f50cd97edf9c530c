import math
import random
import re

import numpy as np
import pytest

from corvane.llm import lexical_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, item_id string, rank string, score string"
ITEMS = "item_id long, text string, doc_id string"


def brute_force(docs, items, k):
    split = lambda t: TERM.findall((t or "").translate(AZ))
    bags = [(i, split(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    out = []
    for item, text in items:
        scores = []
        terms = set(split(text))
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in b for _, b in bags) + 1))) for t in terms}
        for i, b in bags:
            score = 0
            for t in terms:
                if tf := b.count(t):
                    score += weight[t] * (1_000_000_000 * tf // (1000 * tf + 20 * (50 + 50 * len(b) * n_docs // n_terms)))
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = ["the", "É", "Cat", "x9", "日本", "dog-house", "a_b", *[f"w{i}" for i in range(60)]]
    pick = lambda n: " ".join(words[min(int(rng.expovariate(0.12)), len(words) - 1)] for _ in range(n))
    docs = [(i, pick(rng.choice([1, 3, 10, 60]))) for i in range(400)]
    docs += [(rng.randrange(400), docs[7][1]) for _ in range(30)] + [(None, docs[7][1]), (None, "dog"), (900, None), (901, ""), (902, " .,- "), (903, "the " * 400_000)]
    items = [(j, pick(8)) for j in range(12)] + [(3, docs[7][1]), (3, docs[7][1]), (None, "cat DOG"), (50, None), (51, ""), (52, "nowhere"), (53, "The")]
    rng.shuffle(docs)
    return docs, items


@pytest.mark.parametrize("shard,block", [(lexical_search.SHARD_ROWS, lexical_search.ITEM_BYTES), (17, 200)])
def test_search_equals_brute_force(spark, monkeypatch, shard, block):
    docs, items = corpus(shard)
    monkeypatch.setattr(lexical_search, "SHARD_ROWS", shard)
    rows = spark.createDataFrame([(*d, "c", "c", "c") for d in docs], DOCS).repartition(3)
    got = lexical_search.search(rows, spark.createDataFrame([(*i, "c") for i in items], ITEMS), k=5, block_bytes=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_force(docs, items, 5)


def test_search_of_empty_tables(spark):
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a", "c", "c", "c")], DOCS)
    asked = spark.createDataFrame([(1, "a", "c")], ITEMS)
    assert lexical_search.search(none, asked).count() == 0 and lexical_search.search(some, asked.limit(0)).count() == 0
    assert [tuple(r) for r in lexical_search.search(some, asked).collect()] == [(1, 1, 1, 287 * (1_000_000_000 // (1000 + 20 * 100)))]


def test_shard_leaves_early_with_complete_scores(monkeypatch):
    """Rare terms decide: the postings of a frequent one are not processed, yet scores are whole."""
    rng = random.Random(5)
    docs = [(20, *zip(*({0: rng.randint(1, 4)} | ({t: 1 for t in range(1, 6)} if i % 97 == 0 else {})).items(), strict=True)) for i in range(2000)]
    docs = [(n, list(t), list(c)) for n, t, c in docs]
    weights = np.array([1, 7000, 7000, 7000, 7000, 7000], np.int64)
    shard = lexical_search.Shard(docs, weights, 2000, 40_000)
    calls = []
    whole = shard.complete
    monkeypatch.setattr(shard, "complete", lambda *a: calls.append(1) or whole(*a))
    at, score = shard.best(np.arange(6), 10, 1)
    every = lexical_search._exact_sums(np.repeat(np.arange(2000), [len(d[1]) for d in docs]), shard.own[1], 2000)
    assert calls and len(at) < 100
    assert (score == every[at]).all() and set(np.argsort(-every, kind="stable")[:10]) <= set(at)


def test_long_text_is_split_in_pieces(monkeypatch):
    text = ("Ab-é 日本 x" * 5000).encode()
    want = lexical_search.term_counts(text)
    monkeypatch.setattr(lexical_search, "PIECE", 11)
    assert lexical_search.term_counts(text) == want and want[b"ab"] == 1

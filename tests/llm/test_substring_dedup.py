import hashlib
import random

import numpy as np
import pytest

from corvane.llm import substring_dedup
from corvane.llm.common import WORD_RE

DOCS = "doc_id long, text string, n_words string, block string"
WINDOW = substring_dedup.WINDOW


def brute_force(rows):
    """(doc_id, n_words, n_removed, kept_sha256, spans, kept) from the set of all windows."""
    docs = [(i, WORD_RE.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in docs:
        for j in range(len(w) - WINDOW + 1 if i is not None else 0):
            x = tuple(w[j : j + WINDOW])
            first[x] = min(first.get(x, i), i)
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for j in range(len(w) - WINDOW + 1 if i is not None else 0):
            if first[tuple(w[j : j + WINDOW])] < i:
                gone[j : j + WINDOW] = [True] * WINDOW
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        spans, at = [], 0
        while at < len(w):
            end = at
            while end < len(w) and gone[end]:
                end += 1
            if end > at:
                spans.append([at, end])
            at = max(end, at + 1)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), spans, kept))
    return sorted(out, key=str)


def corpus(seed, small=False):
    """Copies, passages at any place, runs, periods, one window at the edge, odd rows."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3 if small else 400)] + ["É", "日本", "x,"]
    new = lambda n: [rng.choice(words) for _ in range(n)]
    passages = [new(n) for n in (12, 13, 14, 20, 55, 300, 1200)] + [["a"] * 40, ["a", "b"] * 30, ["a"] * 9 + new(9), new(2) * 25]
    docs = []
    for _ in range(90):
        text = new(rng.choice([0, 1, 5, 12, 13, 30, 200]))
        for _ in range(rng.choice([0, 1, 1, 2])):
            p = rng.choice(passages)
            cut = rng.randint(0, len(p) // 3)
            at = rng.randint(0, len(text))
            text[at:at] = p[cut : len(p) - rng.randint(0, len(p) // 3)]
        docs.append(text)
    docs += [docs[i] for i in (3, 3, 3, 10, 20)] + [["long", "er"] * 9 + new(3000), new(7) + ["long", "er"] * 9]
    ids = list(range(len(docs)))
    rng.shuffle(ids)
    rows = [(i, rng.choice([" ", "\n", "\t\x0b "]).join(t)) for i, t in zip(ids, docs, strict=True)]
    rows += [(5000, None), (5001, ""), (5002, " \n "), (None, rows[3][1]), (None, " ".join(passages[4])), (rows[0][0], rows[1][1]), rows[2], rows[2], (-9, " ".join(passages[6])), (6000, "y z " * 40)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,block,piece", [(0, substring_dedup.BLOCK_BYTES, substring_dedup.PIECE_WORDS), (1, 3000, 64), (2, 1, 17)])
def test_repeats_equal_brute_force(spark, monkeypatch, seed, block, piece):
    """One block, many blocks, and a document a block; texts whole and in pieces."""
    monkeypatch.setattr(substring_dedup, "PIECE_WORDS", piece)
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, "c", "c") for r in rows], DOCS).repartition(3)
    got = substring_dedup.remove_repeats(docs, texts=True, block_bytes=block)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_force(rows)


def test_repeats_of_few_words_and_empty_table(spark):
    """Three words in all: nearly every window is periodic or repeated."""
    rows = corpus(7, small=True)
    docs = spark.createDataFrame([(*r, "c", "c") for r in rows], DOCS).repartition(2)
    got = substring_dedup.remove_repeats(docs, texts=True, block_bytes=2000)
    assert sorted(map(tuple, got.collect()), key=str) == brute_force(rows)
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n_words", [2, 4, 50, 5000])
def test_equal_windows_have_equal_keys(n_words):
    """Whatever stands around a window, and wherever its piece is cut."""
    rng = np.random.default_rng(n_words)
    names = rng.integers(1, 2**63, n_words).astype(np.uint64)
    words = names[rng.integers(0, n_words, 30_000)]
    words[7000:7040] = words[7000]
    words[9000:12_000] = words[20_000:23_000]
    doc = np.repeat(np.arange(30), 1000)
    keys = {}
    for offset in (0, 5, 333):
        named = substring_dedup.Named(words[offset:], doc[offset:], len(words) - offset)
        for i in np.flatnonzero(named.valid):
            w = words[offset + i : offset + i + WINDOW].tobytes()
            assert keys.setdefault(w, named.key[i]) == named.key[i]
    # a key stands for some windows only
    assert n_words < 50 or len(set(keys.values())) > len(keys) / 8


def test_high_symbols_are_equal_inside_equal_stretches():
    rng = np.random.default_rng(3)
    words = rng.integers(1, 2**63, 20_000).astype(np.uint64)
    other = rng.integers(1, 2**63, 20_000).astype(np.uint64)
    other[5000:9000] = words[11_000:15_000]
    a, b = (substring_dedup.Named(w, np.zeros(len(w), int), len(w)) for w in (words, other))
    inside = (a.start > 11_400) & (a.end < 14_600)
    assert inside.sum() > 50 and np.isin(a.symbol[0][inside], b.symbol[0]).all()
    assert (a.end - a.start).mean() < 60

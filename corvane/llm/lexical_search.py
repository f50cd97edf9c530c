"""Ranked lexical search of every item over all documents, score at a time over impact-ordered postings.

A first pass counts documents, terms, and the documents that hold each term of
the items. The second indexes documents shard by shard (a shard is a bounded block of
a task's rows, so postings are never shuffled): a posting's impact is its exact contribution
w * ((10^9 tf) div (1000 tf + 20 m)), and a term's postings stand by falling impact. For
each item postings of all its terms are processed by falling impact, all postings
of one impact together. What a document can still gain is at most the sum over terms of
the next impact; the shard is left only when that bound is below the k-th
best score known (of the task so far or of this shard), so that no unseen document can
enter, and then the scores of the documents that can are completed from their own postings. Each
task returns at most k documents an item; the best k of those are the result.

Items are taken in blocks of ``block_bytes`` of text (one longer item is a block of
its own); a block's terms are broadcast and the documents are read twice for each block.

NULL or empty texts have no terms: such documents do not count, such items have no rows. Documents of
equal score go by doc_id, NULL ids last; repeated documents are documents of their own, and a
repeated item has rows of its own. Texts of any length are split
a piece at a time and count whole. Empty tables give no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators.scan import numbered
from ..session import Stored
from .common import bounded_batches, lean

#: Bytes that part terms (ASCII but digits and letters) become spaces, A-Z become a-z.
_TABLE = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
#: Bytes of text split at a time.
PIECE = 1 << 20
#: A shard has at most so many documents, and this many bytes of text or one document.
SHARD_ROWS, SHARD_BYTES = 4096, 16 << 20
#: Bytes of item texts searched together.
ITEM_BYTES = 4 << 20


def term_counts(raw: bytes | None) -> Counter:
    """Terms of a UTF-8 text and how often each occurs."""
    found: Counter = Counter()
    if raw:
        raw = raw.translate(_TABLE)
        at = 0
        while at < len(raw):
            end = raw.find(b" ", at + PIECE)
            end = len(raw) if end < 0 else end
            found.update(raw[at:end].split())
            at = end
    return found


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def statistics(texts: DataFrame, vocabulary: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all terms, and the documents that hold each term of the vocabulary."""
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        df, docs, terms = Counter(), 0, 0
        for b in batches:
            for raw in _texts(b, 0):
                found = term_counts(raw)
                docs += bool(found)
                terms += found.total()
                df.update(found.keys() & vocab.keys())
        rows = [(-1, docs), (-2, terms), *((vocab[t], c) for t, c in df.items())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["term", "c"])

    counted = texts.mapInArrow(lean(run), "term long, c long").groupBy("term").agg(F.sum("c").alias("c"))
    # one row for each term of the vocabulary at most
    rows = dict(map(tuple, counted.collect()))
    return rows.get(-1, 0), rows.get(-2, 0), np.array([rows.get(i, 0) for i in range(len(vocabulary))], np.int64)


class Shard:
    """Postings of a block of documents: by term and falling impact, and by document."""

    def __init__(self, docs: list[tuple[int, list[int], list[int]]], weights: np.ndarray, n_docs: int, n_terms: int):
        sizes = [len(d[1]) for d in docs]
        term = np.fromiter((t for d in docs for t in d[1]), np.int64, sum(sizes))
        tf = np.fromiter((c for d in docs for c in d[2]), np.int64, sum(sizes))
        doc = np.repeat(np.arange(len(docs)), sizes)
        m = 50 + 50 * np.array([d[0] for d in docs], np.int64) * n_docs // max(n_terms, 1)
        impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
        self.n = len(docs)
        self.own = term, impact
        self.first = np.append(0, np.cumsum(sizes))
        order = np.lexsort((-impact, term))
        self.impact, self.doc = impact[order], doc[order]
        self.ends = np.searchsorted(term[order], np.arange(len(weights) + 1))

    def best(self, terms: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that may be among the best k and score at least ``least``, with complete scores."""
        lo, hi = self.ends[terms], self.ends[terms + 1]
        sizes = hi - lo
        total = int(sizes.sum())
        # the item's postings, by falling impact over all its terms
        at = np.repeat(lo - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(total)
        impact, doc, mine = self.impact[at], self.doc[at], np.repeat(np.arange(len(terms)), sizes)
        order = np.argsort(-impact, kind="stable")
        impact, doc, mine = impact[order], doc[order], mine[order]
        # a float sums integers below 2^53 exactly, and much faster
        floats = total and int(impact[0]) * len(terms) < 1 << 53
        sums = _float_sums if floats else _exact_sums
        acc = np.zeros(self.n, np.int64)
        done, step, seen, threshold, bound = 0, 4 * k, np.zeros(len(terms), np.int64), least, 0
        while done < total:
            end = min(total, done + step)
            # all postings of one impact are processed together
            end = int(np.searchsorted(-impact, -impact[end - 1], side="right"))
            acc += sums(doc[done:end], impact[done:end], self.n)
            seen += np.bincount(mine[done:end], minlength=len(terms))
            done, step = end, 2 * step
            left = lo + seen < hi
            bound = int(self.impact[(lo + seen)[left]].sum())
            if self.n >= k:
                threshold = max(least, int(np.partition(acc, self.n - k)[self.n - k]))
            if bound < threshold:
                break
        early = done < total
        can = np.flatnonzero(acc + (bound if early else 0) >= threshold)
        scores = self.complete(can, terms) if early else acc[can]
        good = scores >= least
        return can[good], scores[good]

    def complete(self, docs: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Full scores of some documents, from all their postings."""
        asked = np.zeros(len(self.ends), bool)
        asked[terms] = True
        sizes = self.first[docs + 1] - self.first[docs]
        at = np.repeat(self.first[docs] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(int(sizes.sum()))
        term, impact = self.own[0][at], self.own[1][at]
        return _exact_sums(np.repeat(np.arange(len(docs)), sizes), np.where(asked[term], impact, 0), len(docs))


def _exact_sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, at, values)
    return out


def _float_sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at, values, n).astype(np.int64)


class Leaders:
    """The best k documents of one item so far: score, then id, NULL ids last."""

    def __init__(self, k: int):
        self.k, self.score, self.id, self.null = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def least(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        score, ids, null = np.append(self.score, score), np.append(self.id, ids), np.append(self.null, null)
        order = np.lexsort((ids, null, -score))[: self.k]
        self.score, self.id, self.null = score[order], ids[order], null[order]


def _found(texts: DataFrame, vocabulary: dict[bytes, int], items: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): the best k documents of every task and item."""
    shared = texts.sparkSession.sparkContext.broadcast((vocabulary, items, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, asked, w = shared.value
        leaders = [Leaders(k) for _ in asked]
        docs: list[tuple[int, list[int], list[int]]] = []
        ids: list[int | None] = []

        def search() -> None:
            shard = Shard(docs, w, n_docs, n_terms)
            null = np.array([i is None for i in ids])
            plain = np.array([i or 0 for i in ids], np.int64)
            for terms, best in zip(asked, leaders, strict=True):
                at, score = shard.best(terms, k, best.least())
                if len(at):
                    best.add(score, plain[at], null[at])

        held = 0
        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), _texts(b, 1), strict=True):
                found = term_counts(raw)
                terms = found.keys() & vocab.keys()
                if terms:
                    ids.append(i)
                    docs.append((found.total(), [vocab[t] for t in terms], [found[t] for t in terms]))
                held += len(raw or b"")
                if len(docs) >= SHARD_ROWS or held >= SHARD_BYTES and docs:
                    search()
                    docs, ids, held = [], [], 0
        if docs:
            search()
        for item, best in enumerate(leaders):
            n = len(best.score)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, item)), pa.array(best.id, mask=best.null), pa.array(best.score)], names=["item", "doc_id", "score"])

    return texts.mapInArrow(lean(run), "item long, doc_id long, score long")


def _search_block(texts: DataFrame, block: list, k: int) -> DataFrame:
    spark = texts.sparkSession
    terms = [sorted(term_counts((r["_text"] or "").encode("utf-8", "surrogatepass"))) for r in block]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*terms)))}
    n_docs, n_terms, df = statistics(texts.select("text"), vocabulary)
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(c) + 1))) for c in df], np.int64)
    found = _found(texts, vocabulary, [np.array([vocabulary[t] for t in x], np.int64) for x in terms], weights, n_docs, n_terms, k)
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    # the planner keeps k rows of an item in every task before they are dealt
    best = Stored(found.withColumn("rank", rank).filter(F.col("rank") <= k), "search-best").df
    names = spark.createDataFrame([(i, r["_item"]) for i, r in enumerate(block)], "item long, item_id long")
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the best ``k`` documents of every item, scores above 0 only."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    asked = items.select(F.col(item).cast("long").alias("_item"), F.col(item_text).alias("_text"), (F.coalesce(F.octet_length(item_text), F.lit(0)) + 64).cast("long").alias("_bytes"))
    placed = numbered(asked, [], [F.col("_item").asc_nulls_last(), F.col("_text").asc_nulls_first()], {"_bytes": "_upto"})
    blocks = Stored(placed.withColumn("_block", F.floor((F.col("_upto") - F.col("_bytes")) / block_bytes)), "search-items").df
    last = blocks.agg(F.max("_block")).first()[0]
    out = None
    for n in range(0 if last is None else last + 1):
        block = blocks.filter(F.col("_block") == n).select("_item", "_text").collect()
        if block:
            found = _search_block(texts, block, k)
            out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out

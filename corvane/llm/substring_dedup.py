"""Removal of word windows that a document with a smaller id holds too, by recompression.

Recompression names a sequence in rounds: runs of one symbol become one symbol,
then neighbours whose sides (a bit of their names) are left and right become a pair. Names depend
on what they stand for alone, so equal stretches of any two documents get equal
symbols inside, wherever they stand; only symbols at their edges differ. Three uses:

* Keys. Beside a symbol of the second round stands its context: the words that decide it. A window
  that holds a whole context of ``least`` words or more takes as its key the
  smallest digest of such contexts; another window (some 3 in 100) the digest of its own words. The key is a
  function of the window's words, so equal windows have one key; runs of windows share it.
  A Spark round counts keys over all documents: a window whose key is in one document only is unique.
* High-level symbols. Those of round ``rounds`` (32 words on average) are counted in the
  same Spark round with the smallest document of each name; all windows inside one that a
  smaller document has are repeats, and are not looked at again. The smallest document keeps its windows in
  the search, so a window's smallest document is always there.
* Windows left (mostly at the edges of long repeats) are verified one by
  one in a second Spark round: the smallest document of each window, by the digest of all its words.

Texts are packed once into blocks of bounded size. In a round every block deals its
distinct digests to buckets, whose number grows with the corpus, and gets back one bit for each; equal digests of a block
are sent once, so a passage of any share of the documents is a few entries a block.
Digests of windows and names have 96 bits over words told apart by 64.

A NULL text has no words. A row without id keeps its words and is no one's smaller
document; rows of one id do not remove from each other. Texts with fewer words than a window are kept. Texts of any length are
read whole, in pieces that share the last words of the piece before. An empty table gives an empty
result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Stored
from .common import lean
from .shingles import _MIX, _powers, _scramble, _words

#: Words of a window, and of the shortest context that makes a key.
WINDOW, LEAST = 13, 6
#: Rounds whose symbols make keys, rounds in all, and words of the shortest high-level symbol.
KEY_ROUNDS, ROUNDS, LONG = 2, 12, 16
#: Bytes of text (or one document) and documents of a block, words named together.
BLOCK_BYTES, BLOCK_ROWS, PIECE_WORDS = 1 << 20, 5000, 1 << 18
#: Bytes of digests compared together, about.
BUCKET_BYTES, LEAST_BUCKET_BITS, MOST_BUCKET_BITS = 8 << 20, 6, 24
#: Rows of an Arrow batch, since a row is a block.
BATCH_BLOCKS = 32
#: Words of one document hashed together at the end.
OUT_WORDS = 100_000
_U = np.uint64
_NONE = _U(2**64 - 1)


def name_round(name: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, last: np.ndarray, salt: int, context: tuple[np.ndarray, np.ndarray] | None) -> tuple:
    """One round over symbols [start, end) of several sequences, whose first and last symbols are marked.

    ``context`` holds the words [lo, hi) that decide each symbol; what is next to a
    sequence's edge is unknown, so a symbol that depends on it gets a context beyond the edge.
    """
    n = len(name)
    # runs: a run ends where the neighbours differ, so both neighbours decide it
    head = np.ones(n, bool)
    head[1:] = (name[1:] != name[:-1]) | first[1:]
    a = np.flatnonzero(head)
    b = np.append(a[1:], n) - 1
    times = b - a + 1
    named = name[a]
    many = times > 1
    named[many] = _scramble(named[many] * _MIX[3] + times[many].astype(_U))
    if context is not None:
        lo, hi = context
        before, after = np.maximum(a - 1, 0), np.minimum(b + 1, n - 1)
        context = np.where(first[a], start[a] - 1, np.minimum(lo[a], lo[before])), np.where(last[b], end[b] + 1, np.maximum(hi[b], hi[after]))
    name, start, end, first, last = named, start[a], end[b], first[a], last[b]
    # pairs: a left symbol and a right one behind it
    n = len(name)
    left = (_scramble(name + _U(salt)) & _U(1)).astype(bool)
    joins = np.zeros(n, bool)
    joins[:-1] = left[:-1] & ~left[1:] & ~last[:-1]
    a = np.flatnonzero(~np.append(False, joins[:-1]))
    pair = joins[a]
    after = np.minimum(a + 1, n - 1)
    b = np.where(pair, after, a)
    named = name[a]
    named[pair] = _scramble(named[pair] * _MIX[4] + _scramble(name[after[pair]] + _U(1)))
    if context is not None:
        lo, hi = context
        before = np.maximum(a - 1, 0)
        # a right symbol alone depends on what is before it, a left one alone on what follows
        alone_lo = np.where(left[a], lo[a], np.where(first[a], start[a] - 1, np.minimum(lo[a], lo[before])))
        alone_hi = np.where(~left[a], hi[a], np.where(last[a], end[a] + 1, np.maximum(hi[a], hi[after])))
        context = np.where(pair, np.minimum(lo[a], lo[after]), alone_lo), np.where(pair, np.maximum(hi[a], hi[after]), alone_hi)
    return named, start[a], end[b], first[a], last[b], context


class Named:
    """Keys of the windows of a piece, and its high-level symbols."""

    def __init__(self, words: np.ndarray, doc: np.ndarray, windows: int):
        """The piece's first ``windows`` words may begin a window; ``doc`` numbers documents."""
        n = len(words)
        self.words, self.n = words, windows
        edge = doc[1:] != doc[:-1]
        self.valid = np.zeros(windows, bool)
        m = min(windows, max(0, n - WINDOW + 1))
        self.valid[:m] = doc[:m] == doc[WINDOW - 1 : WINDOW - 1 + m]
        up, self._down = _powers(n + 1)
        self._sum = np.zeros(n + 1, _U)
        np.cumsum(words * up[:n], out=self._sum[1:])
        at = np.arange(n)
        name, start, end, first, last, context = words, at, at + 1, np.append(True, edge), np.append(edge, True), (at, at + 1)
        self.key = np.full(windows, _NONE)
        for r in range(1, ROUNDS + 1):
            name, start, end, first, last, context = name_round(name, start, end, first, last, r, context)
            if r == KEY_ROUNDS:
                self._keys(*context)
                context = None
        long = end - start >= LONG
        name, self.start, self.end = name[long], start[long], end[long]
        self.symbol = name, (_scramble(name ^ self._content(self.start, self.end)) >> _U(32)).astype(np.uint32)

    def _content(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Digest of the words [a, b)."""
        return _scramble((self._sum[b] - self._sum[a]) * self._down[a] + (b - a).astype(_U) * _MIX[2])

    def _keys(self, lo: np.ndarray, hi: np.ndarray) -> None:
        whole = (hi - lo >= LEAST) & (hi - lo <= WINDOW) & (lo >= 0) & (hi <= len(self.words))
        lo, hi = lo[whole], hi[whole]
        digest = self._content(lo, hi)
        for back in range(WINDOW - LEAST + 1):
            at = lo - back
            inside = (at >= 0) & (at >= hi - WINDOW) & (at < self.n)
            np.minimum.at(self.key, at[inside], digest[inside])
        bare = np.flatnonzero(self.valid & (self.key == _NONE))
        self.key[bare] = self._content(bare, bare + WINDOW)


class Block:
    """A block's documents, words and pieces."""

    def __init__(self, ids: list[int | None], sizes: list[int], blob: bytes):
        self.ids, self.null = np.array([i or 0 for i in ids], np.int64), np.array([i is None for i in ids], bool)
        self.raw = pa.decompress(blob, sum(sizes), codec="zstd", asbytes=True) if sum(sizes) else b""
        # a line end stands behind every text
        self.words, self.starts = _words(self.raw) if self.raw else (np.zeros(0, _U), np.zeros(0, np.int64))
        self.first = np.searchsorted(self.starts, np.cumsum([0, *sizes]))
        self.doc = np.repeat(np.arange(len(ids)), np.diff(self.first))

    def pieces(self) -> Iterator[tuple[int, Named]]:
        for at in range(0, len(self.words), PIECE_WORDS):
            to = min(at + PIECE_WORDS, len(self.words))
            end = min(to + WINDOW - 1, len(self.words))
            named = Named(self.words[at:end], self.doc[at:end], to - at)
            named.valid &= ~self.null[self.doc[at:to]]
            yield at, named


def least_docs(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct digests in order with the smallest document of each, and each entry's place among them."""
    order = np.lexsort((doc, h2, h1))
    a, b = h1[order], h2[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    place = np.empty(len(a), np.int64)
    place[order] = np.cumsum(new) - 1
    return a[new], b[new], doc[order][new], place


class Collected:
    """What a block sends in the first round, computed alike whenever the block is read."""

    def __init__(self, block: Block):
        keys, docs, names, checks, owners = [], [], [], [], []
        self.spans: list[tuple[np.ndarray, np.ndarray]] = []
        self.window_keys = []
        for at, named in block.pieces():
            key, doc = np.where(named.valid, named.key, _NONE), block.doc[at : at + named.n]
            self.window_keys.append(key)
            change = np.ones(len(key), bool)
            change[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            some = np.flatnonzero(change & (key != _NONE))
            keys.append(key[some])
            docs.append(block.ids[doc[some]])
            owner = block.doc[at + named.start] if len(named.start) else np.zeros(0, np.int64)
            good = ~block.null[owner] & (named.start < named.n)
            names.append(named.symbol[0][good])
            checks.append(named.symbol[1][good])
            owners.append(block.ids[owner[good]])
            # windows inside the symbol that begin in this piece
            self.spans.append((at + named.start[good], at + np.minimum(named.end[good] - WINDOW + 1, named.n)))
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        key, doc = join(keys, _U), join(docs, np.int64)
        # the last bit says that the block has the key in two documents
        key &= ~_U(1)
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        at = np.flatnonzero(new)
        self.keys = key[at]
        self.several = doc[np.append(at[1:], len(key)) - 1] != doc[at] if len(at) else np.zeros(0, bool)
        self.n1, self.n2, self.least, self.place = least_docs(join(names, _U), join(checks, np.uint32), join(owners, np.int64))
        self.owner = join(owners, np.int64)


#: What travels: a block's digests for a bucket, bits that come back, or (bucket -1) what a block tells itself.
_FIELDS = [("block", pa.int64()), ("bucket", pa.int64()), ("h1", pa.binary()), ("h2", pa.binary()), ("doc", pa.binary())]
_SCHEMA = pa.schema(_FIELDS)
_DDL = "block long, bucket long, h1 binary, h2 binary, doc binary"


def _deal(block: int, base: int, bits: int, h1: np.ndarray, h2: np.ndarray | None, doc: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Rows of sorted digests by their leading bits."""
    bucket = h1 >> _U(64 - bits)
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(h1) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(h1))
    for at in range(0, len(cut), 512):
        some = list(zip(cut[at : at + 512].tolist(), ends[at : at + 512].tolist(), strict=True))
        cols = [pa.array([block] * len(some), pa.int64()), pa.array([base + int(bucket[a]) for a, _ in some], pa.int64())]
        cols += [pa.array([x[a:b].tobytes() if x is not None else None for a, b in some], pa.binary()) for x in (h1, h2, doc)]
        yield pa.RecordBatch.from_arrays(cols, schema=_SCHEMA)


def packed(docs: DataFrame, key: str, text: str, block_bytes: int) -> DataFrame:
    """(block, ids, sizes, blob): texts with a line end behind each, compressed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, texts, held = TaskContext.get().partitionId() << 24, [], [], 0

        def close() -> pa.RecordBatch:
            blob = pa.compress(b"".join(texts), codec="zstd", asbytes=True)
            cols = [pa.array([block]), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([blob], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["block", "ids", "sizes", "blob"])

        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids.append(i)
                texts.append((raw or b"") + b"\n")
                held += len(texts[-1])
                if held >= block_bytes or len(ids) >= BLOCK_ROWS:
                    yield close()
                    block, ids, texts, held = block + 1, [], [], 0
        if ids:
            yield close()

    plain = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return plain.mapInArrow(lean(run), "block long, ids array<long>, sizes array<long>, blob binary")


def sent(blocks: DataFrame, bits: int) -> DataFrame:
    """First round: distinct keys (buckets below 2^bits) and high-level symbols with their smallest document (above)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                c = Collected(Block(r["ids"], r["sizes"], r["blob"]))
                yield from _deal(r["block"], 0, bits, c.keys | c.several.astype(_U), None, None)
                yield from _deal(r["block"], 1 << bits, bits, c.n1, c.n2, c.least)

    return blocks.mapInArrow(lean(run), _DDL)


def answered(dealt: DataFrame, bits: int) -> DataFrame:
    """A bit for each digest of a block: whether another document has the key, or whether a smaller one has the symbol or window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            sizes = [len(h[1]) // 8 for h in held]
            h1 = np.frombuffer(b"".join(h[1] for h in held), _U)
            if current < 1 << bits:
                key = h1 & ~_U(1)
                _, place, times = np.unique(key, return_inverse=True, return_counts=True)
                several = np.bincount(place, (h1 & _U(1)).astype(np.int64)) > 0
                bit = ((times > 1) | several)[place]
            else:
                h2, doc = np.frombuffer(b"".join(h[2] for h in held), np.uint32), np.frombuffer(b"".join(h[3] for h in held), np.int64)
                _, _, least, place = least_docs(h1, h2, doc)
                bit = least[place] < doc
            ends = np.cumsum(sizes)
            rows = [np.packbits(bit[e - s : e]).tobytes() for s, e in zip(sizes, ends, strict=True)]
            for at in range(0, len(held), 512):
                some = held[at : at + 512]
                m = len(some)
                yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in some], pa.int64()), pa.array([current] * m, pa.int64()), pa.array(rows[at : at + m], pa.binary()), pa.nulls(m, pa.binary()), pa.array([np.int64(s).tobytes() for s in sizes[at : at + m]], pa.binary())], schema=_SCHEMA)

        for b in batches:
            for i, bucket in enumerate(b.column(1).to_pylist()):
                if bucket < 0:
                    yield b.slice(i, 1)
                    continue
                if bucket != current:
                    if held:
                        yield from close()
                    current, held = bucket, []
                held.append(tuple(b.column(c)[i].as_py() for c in (0, 2, 3, 4)))
        if held:
            yield from close()

    where = F.when(F.col("bucket") < 0, F.xxhash64("block")).otherwise(F.col("bucket"))
    return dealt.repartition(where).sortWithinPartitions("bucket").mapInArrow(lean(run), _DDL)


def _with_blocks(blocks: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of a block in the order of their buckets, then the block itself."""
    nothing = {c: F.lit(None).cast(t) for c, t in (("ids", "array<long>"), ("sizes", "array<long>"), ("blob", "binary"))}
    other = {c: F.lit(None).cast("binary") for c in ("h1", "h2", "doc")}
    both = rows.select("block", "bucket", "h1", "h2", "doc", *[v.alias(c) for c, v in nothing.items()])
    own = blocks.select("block", F.lit(2**62).alias("bucket"), *[v.alias(c) for c, v in other.items()], "ids", "sizes", "blob")
    return both.unionByName(own).repartition("block").sortWithinPartitions("block", "bucket")


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[tuple]]]:
    """A block with the rows that came back to it: (bucket, h1, h2, doc)."""
    held: list[tuple] = []
    for b in batches:
        for i, bucket in enumerate(b.column(1).to_pylist()):
            if bucket < 2**62:
                held.append((bucket, *(b.column(c)[i].as_py() for c in (2, 3, 4))))
            else:
                yield {c: b.column(c)[i].as_py() for c in ("block", "ids", "sizes", "blob")}, held
                held = []


def _bits(rows: list[tuple], n: int) -> np.ndarray:
    """Answers in the order in which the digests were sent."""
    parts = [np.unpackbits(np.frombuffer(r[1], np.uint8), count=int(np.frombuffer(r[3], np.int64)[0])) for r in rows]
    out = np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)
    if len(out) != n:
        raise RuntimeError("a block was answered for other digests than it sent")
    return out


def windows_left(blocks: DataFrame, answers: DataFrame, bits: int) -> DataFrame:
    """Second round: windows that no high-level symbol decides and whose key others share; with them (bucket -1) what is decided."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, back in _by_block(batches):
            block = Block(row["ids"], row["sizes"], row["blob"])
            c = Collected(block)
            shared = _bits([x for x in back if x[0] < 1 << bits], len(c.keys))
            smaller = _bits([x for x in back if x[0] >= 1 << bits], len(c.n1))
            repeated = (smaller[c.place] | (c.owner > c.least[c.place])) if len(c.place) else np.zeros(0, bool)
            edges = np.zeros(len(block.words) + 1, np.int64)
            spans = [np.concatenate(x) for x in zip(*c.spans, strict=True)] if c.spans else [np.zeros(0, np.int64)] * 2
            np.add.at(edges, spans[0][repeated], 1)
            np.add.at(edges, spans[1][repeated], -1)
            decided = np.cumsum(edges)[:-1] > 0
            key = np.concatenate(c.window_keys) if c.window_keys else np.zeros(0, _U)
            del c, edges
            keys = _keys_of(key, shared)
            at = np.flatnonzero(keys & ~decided)
            h1, h2 = _window_digests(block.words, at)
            doc = block.ids[block.doc[at]]
            d1, d2, least, place = least_docs(h1, h2, doc)
            decided[at[doc > least[place]]] = True
            asked = np.zeros(len(decided), bool)
            asked[at[doc == least[place]]] = True
            told = pa.RecordBatch.from_arrays([pa.array([row["block"]]), pa.array([-1], pa.int64()), pa.array([np.packbits(decided).tobytes()], pa.binary()), pa.array([np.packbits(asked).tobytes()], pa.binary()), pa.nulls(1, pa.binary())], schema=_SCHEMA)
            yield told
            yield from _deal(row["block"], 1 << bits, bits, d1, d2, least)

    return _with_blocks(blocks, answers).mapInArrow(lean(run), _DDL)


def _keys_of(key: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Windows whose key is among the shared of the block's distinct keys."""
    some = np.flatnonzero(key != _NONE)
    distinct = np.unique(key[some] & ~_U(1))
    out = np.zeros(len(key), bool)
    out[some] = shared[np.searchsorted(distinct, key[some] & ~_U(1))]
    return out


def _window_digests(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, g = np.full(len(at), WINDOW, _U), np.full(len(at), 1, _U)
    for j in range(WINDOW):
        w = words[at + j]
        h = _scramble(h * _MIX[3] + w)
        g = (g ^ w) * _MIX[1]
        g ^= g >> _U(29)
    return h, (g >> _U(32)).astype(np.uint32)


def results(blocks: DataFrame, answers: DataFrame, key: str, texts: bool) -> DataFrame:
    """What is left of every document."""
    schema = pa.schema([(key, pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.list_(pa.int64()))), *([("kept", pa.string())] if texts else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, back in _by_block(batches):
            block = Block(row["ids"], row["sizes"], row["blob"])
            n = len(block.words)
            told = next(x for x in back if x[0] == -1)
            removed = np.unpackbits(np.frombuffer(told[1], np.uint8), count=n).astype(bool)
            # digests are computed again rather than sent along
            at = np.flatnonzero(np.unpackbits(np.frombuffer(told[2], np.uint8), count=n))
            distinct, _, _, place = least_docs(*_window_digests(block.words, at), at)
            smaller = _bits([x for x in back if x[0] >= 0], len(distinct))
            removed[at[smaller[place]]] = True
            cover = np.zeros(n + WINDOW + 1, np.int32)
            np.add.at(cover, np.flatnonzero(removed), 1)
            np.add.at(cover, np.flatnonzero(removed) + WINDOW, -1)
            gone = np.cumsum(cover)[:n] > 0
            out: list[list] = [[] for _ in schema]
            for d, i in enumerate(row["ids"]):
                a, b = int(block.first[d]), int(block.first[d + 1])
                sha, kept = hashlib.sha256(), []
                began = False
                for lo in range(a, b, OUT_WORDS):
                    hi = min(lo + OUT_WORDS, b)
                    end = int(block.starts[hi]) if hi < n else len(block.raw)
                    words = block.raw[int(block.starts[lo]) : end].split()
                    piece = b" ".join(words if not gone[lo:hi].any() else compress(words, ~gone[lo:hi]))
                    if not gone[lo:hi].all():
                        sha.update(b" " + piece if began else piece)
                        kept.append(piece)
                        began = True
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone[a:b], [False]]).astype(np.int8)))
                values = [i, b - a, int(gone[a:b].sum()), sha.hexdigest(), edge.reshape(-1, 2).tolist()]
                for column, v in zip(out, [*values, b" ".join(kept).decode("utf-8", "replace")] if texts else values, strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    ddl = f"`{key}` long, n_words long, n_removed long, kept_sha256 string, spans array<array<long>>" + (", kept string" if texts else "")
    return _with_blocks(blocks, answers).mapInArrow(lean(run), ddl)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", texts: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256, spans) of every document, with the text left if ``texts``; spans are the removed words [from, to)."""
    spark = docs.sparkSession
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(rows)
    spark.conf.set(rows, str(BATCH_BLOCKS))
    try:
        blocks = Stored(packed(docs, key, text, block_bytes), "repeats-blocks")
        size = blocks.df.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
        # some 4 bytes of digest for every 6 of text
        bits = min(MOST_BUCKET_BITS, max(LEAST_BUCKET_BITS, math.ceil(math.log2(max(1, 2 * size / 3 / BUCKET_BYTES)))))
        first = Stored(answered(sent(blocks.df, bits), bits), "repeats-first")
        second = Stored(answered(windows_left(blocks.df, first.df, bits), bits), "repeats-second")
        first.drop()
        out = Stored(results(blocks.df, second.df, key, texts), "repeats-kept")
        second.drop()
        blocks.drop()
    finally:
        spark.conf.set(rows, usual)
    return out.df

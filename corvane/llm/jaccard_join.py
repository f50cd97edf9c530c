"""Exact Jaccard join of word-shingle sets, as classes of documents linked directly or through others.

Method: token-combination prefixes. A token is a shingle's hash. Every token
is counted over the whole corpus; the global order of tokens is (count, hash),
so those that occur once come first and match nothing. Two sets at similarity
t share a token among the first n - ceil(t n) + 1 of either. Rare tokens (up
to ``rare_most`` sets) of that prefix are indexed alone. If the first shared
token is frequent, all shared tokens are, and the sets share l of them in the
prefix extended by l - 1; frequent tokens are split into l - 1 residue classes, two shared
ones fall into one class, and so only 2-token combinations within a class are indexed. l
grows with the size band of the pair (bands are a factor 1/t wide, each set is
indexed for its own band and the next), which keeps the combinations in
proportion to the set. An index entry holds the tokens left from its place
on (``room``): a pair whose smaller room is below the overlap it needs cannot link and never
becomes a row.

Counting: texts are hashed in blocks of bounded size; the tokens of a block
are dealt by their leading bits to buckets, whose number grows with the
corpus, and a bucket is counted at a time. Tokens that occur twice or more
go back to their block, where prefixes are cut. Sets share only such tokens, so
these, with the sets' sizes, verify a pair exactly; texts are read once.

Sets of equal content are one node. Candidates of a key are compared with the
key's leader (the member with the smallest share of tokens of its own) first, each node with
one leader, then with the others of another class; what remains are pairs of different classes
that share a key. No link is lost: a pair left unverified is in one class.

Ids are integers, or text that reads as such; others raise. Empty sets (NULL
or empty text, no words) link with nothing. NULL ids get a NULL class unless their text has the words
of a row with an id. Repeated rows are one node; rows of one id and other texts are
nodes of their own. Of equally good leaders the first in the table's order leads, which changes
no result. Texts of any length are hashed whole, one at a time. Extra columns are ignored by
``near_duplicates``, whatever their names, and carried by ``representatives``.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Stored
from .common import bounded_batches, hot_join, if_small, lean
from .components import components
from .shingles import shingle_sets

#: Tokens in more sets than this are frequent and indexed by combinations.
RARE_MOST = 64
#: Bytes of text hashed together, and the most rows of a block (their numbers take 16 bits).
BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 50_000
#: Bytes of tokens counted together, about; the number of buckets is a power of two between these bounds.
BUCKET_BYTES, LEAST_BUCKET_BITS, MOST_BUCKET_BITS = 8 << 20, 8, 24
#: A leader is compared with about this many partners in one group.
GROUP_PAIRS = 64
#: Rows that name sets to verify or classes (under 40 bytes each), broadcast up to this number, joined by shuffle beyond.
ROLES_BROADCAST, NODES_BROADCAST = 200_000, 400_000
_LOW = np.uint64((1 << 48) - 1)
#: The last bit of an index key tells a combination of frequent tokens (1) from a single token (0).
_EVEN = np.uint64(2**64 - 2)


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, list, list]]:
    """Ids, hashes and texts in blocks of bounded size."""
    block: tuple[list, list, list] = ([], [], [])
    held = 0
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            for column, x in zip(block, row, strict=True):
                column.append(x)
            held += len(row[2] or "") + 64
            if held >= most or len(block[0]) >= BLOCK_ROWS:
                yield block
                block, held = ([], [], []), 0
    if block[0]:
        yield block


def _signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    a = int(np.bitwise_xor.reduce(s * np.uint64(0x9E3779B97F4A7C15) ^ (s >> np.uint64(29))))
    b = int((s * (s | np.uint64(1))).sum(dtype=np.uint64)) ^ len(s)
    return (a ^ (1 << 63)) - (1 << 63), (b ^ (1 << 63)) - (1 << 63)


# what travels about the rows of a block: ids, hashes of the texts, set sizes, signatures, and whether the row stands for its set
_ABOUT = ["ids", "hashes", "n", "s1", "s2", "lead"]
_ABOUT_TYPES = [*[pa.list_(pa.int64())] * 5, pa.list_(pa.bool_())]
_ABOUT_SCHEMA = "ids array<long>, hashes array<long>, n array<long>, s1 array<long>, s2 array<long>, lead array<boolean>"
_DEALT = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("tokens", pa.binary()), *zip(_ABOUT, _ABOUT_TYPES, strict=True)])
_COUNTED = ["block", "rows", "tokens", "counts", *_ABOUT]


def _about_nothing(m: int) -> list[pa.Array]:
    return [pa.nulls(m, t) for t in _ABOUT_TYPES]


def dealt_tokens(texts: DataFrame, k: int, bits: int, block_bytes: int) -> DataFrame:
    """Per block and bucket its tokens (48 bits, then the row's number in 16), and one row (bucket -1) about the block's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 24
        for number, (ids, hashes, block) in enumerate(_blocks(batches, block_bytes)):
            sets = shingle_sets(block, k)
            n, s1, s2, first = [], [], [], {}
            for row, s in enumerate(sets):
                a, b = _signature(s) if len(s) else (None, None)
                n.append(len(s))
                s1.append(a)
                s2.append(b)
                if len(s) and ids[row] is not None and ((a, b) not in first or ids[row] < ids[first[a, b]]):
                    first[a, b] = row
            leads = sorted(first.values())
            stands = set(leads)
            about = zip(_ABOUT, (ids, hashes, n, s1, s2, [r in stands for r in range(len(ids))]), strict=True)
            yield pa.RecordBatch.from_pylist([{"block": part + number, "bucket": -1, **dict(about)}], schema=_DEALT)
            if not leads:
                continue
            tokens = np.concatenate([sets[r] for r in leads])
            rows = np.repeat(np.array(leads, np.uint64), [n[r] for r in leads])
            del sets, s
            bucket = tokens >> np.uint64(64 - bits)
            order = np.argsort(bucket.astype(np.uint16) if bits <= 16 else bucket, kind="stable")
            bucket = bucket[order]
            packed = ((tokens & _LOW) << np.uint64(16) | rows)[order]
            del tokens, rows, order
            cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            ends = np.append(cut[1:], len(bucket))
            for at in range(0, len(cut), 512):
                some = range(at, min(at + 512, len(cut)))
                m = len(some)
                yield pa.RecordBatch.from_arrays([pa.array([part + number] * m, pa.int64()), pa.array(bucket[cut[at : at + m]].astype(np.int64)), pa.array([packed[cut[i] : ends[i]].tobytes() for i in some], pa.binary()), *_about_nothing(m)], schema=_DEALT)

    return texts.mapInArrow(lean(run), f"block long, bucket long, tokens binary, {_ABOUT_SCHEMA}")


def counted_tokens(dealt: DataFrame, bits: int) -> DataFrame:
    """Per block and bucket the tokens that occur twice or more: (rows, tokens, counts); other rows pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, blocks = None, [], []

        def close() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            sizes = [len(h) for h in held]
            every = np.concatenate(held)
            order = np.argsort(every >> np.uint64(16), kind="stable")
            token = (every >> np.uint64(16))[order]
            edge = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            times = np.diff(np.append(edge, len(token)))
            count = np.empty(len(every), np.int64)
            count[order] = np.repeat(times, times)
            del order, token
            high = np.uint64((current >> max(0, bits - 16)) << 48)
            at, out = 0, []
            for b, size in zip(blocks, sizes, strict=True):
                part, c = every[at : at + size], count[at : at + size]
                at += size
                two = c > 1
                if two.any():
                    part = part[two]
                    out.append((b, (part & np.uint64(0xFFFF)).astype(np.uint16).tobytes(), ((part >> np.uint64(16)) | high).tobytes(), c[two].tobytes()))
            for at in range(0, len(out), 512):
                some = list(zip(*out[at : at + 512], strict=True))
                m = len(some[0])
                yield pa.RecordBatch.from_arrays([pa.array(some[0], pa.int64()), *[pa.array(x, pa.binary()) for x in some[1:]], *_about_nothing(m)], names=_COUNTED)

        for batch in batches:
            for i, (block, bucket, raw) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True)):
                if bucket < 0:
                    one = batch.slice(i, 1)
                    yield pa.RecordBatch.from_arrays([one.column(0), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), *one.columns[3:]], names=_COUNTED)
                    continue
                if bucket != current:
                    yield from close()
                    current, held, blocks = bucket, [], []
                held.append(np.frombuffer(raw, np.uint64))
                blocks.append(block)
        yield from close()

    return dealt.mapInArrow(lean(run), f"block long, rows binary, tokens binary, counts binary, {_ABOUT_SCHEMA}")


def band_of(n: int, num: int, den: int) -> int:
    """Size band: sizes that can reach the similarity lie in the same or the next band."""
    return int(math.floor(math.log(n) / math.log(den / num) + 1e-9))


def index_keys(tokens: np.ndarray, counts: np.ndarray, n: int, num: int, den: int, rare_most: int = RARE_MOST) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of a set of n tokens and the rooms behind them, from its tokens of count two or more."""
    prefix, own = n - -(-num * n // den) + 1, n - len(tokens)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if own >= prefix:
        return none
    order = np.lexsort((tokens, counts))
    tokens, rare = tokens[order], int((counts <= rare_most).sum())
    single = tokens[: min(rare, prefix - own)] if n > 1 else tokens
    keys, rooms = [single & _EVEN], [len(tokens) - np.arange(len(single))]
    first = own + rare  # the place of the first frequent token
    if n > 1 and first < prefix:
        band, hot = band_of(n, num, den), tokens[rare:]
        for b in (band, band + 1):
            # the same for both sets of a pair: l - 1 classes, where l shared tokens are certain
            low = (den / num) ** b
            classes = max(1, min(int(low * (den - num) / den), math.ceil(low * num * num / (den * den)) - 1))
            part = hot[: prefix + classes - first]
            cls = part % np.uint64(classes)
            order = np.argsort(cls, kind="stable")
            part, cls = part[order], cls[order]
            # members of a class stand together: combine those 1, 2, ... places apart
            step = 1
            while step < len(part):
                same = cls[step:] == cls[:-step]
                if not same.any():
                    break
                x, y = part[:-step][same], part[step:][same]
                x, y = np.minimum(x, y), np.maximum(x, y)
                keys.append(((x * np.uint64(0xD6E8FEB86659FD93) ^ (y >> np.uint64(7))) * np.uint64(0x9E3779B97F4A7C15) + y + np.uint64(b)) | np.uint64(1))
                rooms.append(np.full(len(x), n - first))
                step += 1
    keys, at = np.unique(np.concatenate(keys), return_index=True)
    return (keys, np.concatenate(rooms)[at]) if len(keys) else none


def index_rows(counted: DataFrame, num: int, den: int, rare_most: int) -> DataFrame:
    """Every row as (id, n, s1, s2); the first of a set in its block also has v, own share, tokens, and keys with rooms if it can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, about, parts = None, None, []

        def close() -> Iterator[pa.RecordBatch]:
            ids, hashes, n, s1, s2, lead = about
            row = np.concatenate([np.frombuffer(p[0], np.uint16) for p in parts]) if parts else np.zeros(0, np.uint16)
            tokens = np.concatenate([np.frombuffer(p[1], np.uint64) for p in parts]) if parts else np.zeros(0, np.uint64)
            counts = np.concatenate([np.frombuffer(p[2], np.int64) for p in parts]) if parts else np.zeros(0, np.int64)
            order = np.lexsort((tokens, row))
            row, tokens, counts = row[order], tokens[order], counts[order]
            lo, hi = (np.searchsorted(row, np.arange(len(ids)), side=x) for x in ("left", "right"))
            v, own, held, keys, rooms = ([None] * len(ids) for _ in range(5))
            for r in range(len(ids)):
                if lead[r]:
                    v[r] = current << 16 | r
                    mine = slice(lo[r], hi[r])
                    k, m = index_keys(tokens[mine], counts[mine], n[r], num, den, rare_most)
                    if len(k):
                        own[r], held[r], keys[r], rooms[r] = 1 - (hi[r] - lo[r]) / n[r], tokens[mine].tobytes(), k.view(np.int64), m
            for at in range(0, len(ids), 2000):
                to = at + 2000
                cols = [*[pa.array(c[at:to], pa.int64()) for c in (ids, hashes, n, s1, s2, v)], pa.array(own[at:to], pa.float64()), pa.array(held[at:to], pa.binary()), pa.array(keys[at:to], pa.list_(pa.int64())), pa.array(rooms[at:to], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "h", "n", "s1", "s2", "v", "own", "tokens", "keys", "rooms"])

        for batch in batches:
            for i, (block, *part) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(4)), strict=True)):
                if block != current:
                    if current is not None:
                        yield from close()
                    current, about, parts = block, None, []
                if part[0] is None:
                    about = tuple(batch.column(j)[i].as_py() for j in range(4, 10))
                else:
                    parts.append(part)
        if current is not None:
            yield from close()

    return counted.mapInArrow(lean(run), "id long, h long, n long, s1 long, s2 long, v long, own double, tokens binary, keys array<long>, rooms array<long>")


def _fits(num: int, den: int) -> Column:
    """Whether the tokens left behind a shared key allow the overlap that rows (na, ra) and (nb, rb) need."""
    return F.least("ra", "rb") * (den + num) >= (F.col("na") + F.col("nb")) * num


def _groups(pairs: DataFrame) -> DataFrame:
    """(g, a, v, role): the sets that a comparison of pairs (a, b) needs, role 0 for the set a that leads group g.

    A set with more than about GROUP_PAIRS partners leads several groups, so no group grows with their number.
    """
    degree = Stored(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_d")), "jaccard-degrees").df
    led = hot_join(pairs, degree, ["a"], "_d", pairs.count())
    parts = F.ceil(F.col("_d") / GROUP_PAIRS).cast("long")
    dealt = Stored(led.select("a", "b", F.xxhash64("a", F.pmod(F.xxhash64("b"), parts)).alias("g")), "jaccard-dealt").df
    return dealt.select("g", "a", F.col("a").alias("v"), F.lit(0).alias("role")).distinct().unionByName(dealt.select("g", "a", F.col("b").alias("v"), F.lit(1).alias("role")))


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets (v, n, tokens) reach the similarity; a task holds a leader beside the current batch."""
    roles = Stored(_groups(pairs), "jaccard-roles").df
    rows = sets.join(if_small(roles, ROLES_BROADCAST), "v").select("g", "a", "role", "v", "n", "tokens")
    rows = rows.repartition("g").sortWithinPartitions("g", "a", "role")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, lead, size = None, np.zeros(0, np.uint64), 0
        for batch in batches:
            out_a, out_b = [], []
            for g, a, role, v, n, raw in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                s = np.frombuffer(raw, np.uint64)
                if role == 0:
                    current, lead, size = (g, a), s, n
                    continue
                if (g, a) != current:
                    raise RuntimeError("a group without its leader")
                shared = len(np.intersect1d(lead, s, assume_unique=True))
                if den * shared >= num * (n + size - shared):
                    out_a.append(a)
                    out_b.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(lean(check), "a long, b long")


def _classes(edges: DataFrame, label: str) -> DataFrame:
    return Stored(components(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))), label).df


def _apart(pairs: DataFrame, cc: DataFrame) -> DataFrame:
    """Pairs whose ends are in different classes."""
    small = if_small(cc, NODES_BROADCAST)
    both = pairs.join(small.select(F.col("node").alias("a"), F.col("component").alias("_ca")), "a", "left").join(small.select(F.col("node").alias("b"), F.col("component").alias("_cb")), "b", "left")
    return both.filter(F.coalesce("_ca", "a") != F.coalesce("_cb", "b")).select("a", "b")


def _between(shared: DataFrame, cc: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of different classes that share a key and may link.

    Keys inside one class drop out first. In every other key the members of
    its largest class form one side only, so that class is never paired with
    itself.
    """
    named = Stored(shared.join(if_small(cc, NODES_BROADCAST), F.col("v") == cc["node"], "left").select("key", "v", "n", "room", F.coalesce("component", "v").alias("class")), "jaccard-named").df
    by_class = named.groupBy("key", "class").agg(F.count(F.lit(1)).alias("c"), F.max("room").alias("room"))
    mixed = by_class.groupBy("key").agg(F.max_by("class", F.struct("c", "class")).alias("_main"), F.sum("c").alias("_c"), F.count(F.lit(1)).alias("_classes")).filter("_classes > 1")
    mixed = Stored(mixed.drop("_classes"), "jaccard-mixed").df
    rows = Stored(hot_join(named, mixed, ["key"], "_c", max(named.count(), 1)).withColumn("minor", F.col("class") != F.col("_main")).drop("_main", "_c"), "jaccard-sides").df
    a = rows.filter("minor").select("key", F.col("v").alias("a"), F.col("n").alias("na"), F.col("room").alias("ra"), F.col("class").alias("ca"))
    b = rows.select(F.col("key").alias("_key"), F.col("v").alias("b"), F.col("n").alias("nb"), F.col("room").alias("rb"), F.col("class").alias("cb"), F.col("minor").alias("mb"))
    apart = (F.col("ca") != F.col("cb")) & (~F.col("mb") | (F.col("a") < F.col("b")))
    return a.join(b, (F.col("key") == F.col("_key")) & apart & _fits(num, den)).select("a", "b").distinct()


def _labelled(docs: DataFrame, key: str, text: str, k: int, num: int, den: int, rare_most: int, block_bytes: int) -> DataFrame:
    """(id, h, n, _n, _class) of every row; h is a hash of its text as it stands."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("t"))
    # some 8 bytes of token for every 6 of text
    size = texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    bits = min(MOST_BUCKET_BITS, max(LEAST_BUCKET_BITS, math.ceil(math.log2(max(1, 4 * size / 3 / BUCKET_BYTES)))))
    dealt = dealt_tokens(texts, k, bits, block_bytes).repartition(F.when(F.col("bucket") < 0, F.xxhash64("block")).otherwise(F.col("bucket"))).sortWithinPartitions("bucket")
    counted = counted_tokens(dealt, bits).repartition("block").sortWithinPartitions("block")
    index = Stored(index_rows(counted, num, den, rare_most), "jaccard-index")
    light = Stored(index.df.select("id", "h", "n", "s1", "s2"), "jaccard-light").df
    total = light.count()
    by_set = Stored(index.df.filter("n > 0").groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.min("v").alias("node"), F.count("v").alias("_blocks"), F.count(F.lit(1)).alias("_n")), "jaccard-sets").df
    sets = index.df.filter("keys is not null").select("v", "n", "tokens")
    edges, cc = _linked(index, by_set, sets, num, den)
    index.drop()
    classed = Stored(by_set.join(if_small(cc, NODES_BROADCAST), by_set["node"] == cc["node"], "left").select("s1", "s2", "rep", "_n", F.coalesce("component", by_set["node"]).alias("_c")), "jaccard-classed").df
    least = Stored(classed.filter("_c is not null").groupBy("_c").agg(F.min("rep").alias("_class"), F.count(F.lit(1)).alias("_m")), "jaccard-least").df
    label = Stored(hot_join(classed, least, ["_c"], "_m", max(classed.count(), 1), "left").select("s1", "s2", "_n", "_class"), "jaccard-labels").df
    full = hot_join(light.filter("n > 0"), label, ["s1", "s2"], "_n", total).select("id", "h", "n", "_n", "_class")
    return full.unionByName(light.filter("n = 0").select("id", "h", "n", F.lit(1).cast("long").alias("_n"), F.col("id").alias("_class")))


def _linked(index: Stored, by_set: DataFrame, sets: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Links found, and (node, component) of every node that has one."""
    # of a set that several blocks met one node stays
    more = Stored(index.df.filter("v is not null").select("s1", "s2", "v").join(by_set.filter("_blocks > 1").select("s1", "s2", "node"), ["s1", "s2"]).filter("v <> node").select("v"), "jaccard-more").df
    linking = index.df.filter("keys is not null").select("v", "n", "own", "keys", "rooms").join(if_small(more, NODES_BROADCAST), "v", "left_anti")
    flat = linking.select("v", "n", "own", F.explode(F.arrays_zip("keys", "rooms")).alias("_k")).select(F.col("_k.keys").alias("key"), "v", "n", "own", F.col("_k.rooms").alias("room"))
    flat = Stored(flat, "jaccard-keys")
    # counting collapses a common key in the map tasks; keys met once end here
    keys = Stored(flat.df.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("own", "v", "n", "room")).alias("l")).filter("c > 1"), "jaccard-leaders").df
    keys = keys.select("key", "c", F.col("l.own").alias("lead_own"), F.col("l.v").alias("lead"), F.col("l.n").alias("nb"), F.col("l.room").alias("rb"))
    shared = Stored(hot_join(flat.df, keys, ["key"], "c", max(flat.df.count(), 1)), "jaccard-shared")
    flat.drop()
    stars = shared.df.filter("v <> lead").withColumnsRenamed({"n": "na", "room": "ra"}).filter(_fits(num, den))
    stars = Stored(stars.groupBy(F.col("lead").alias("a"), F.col("v").alias("b")).agg(F.min("lead_own").alias("own")), "jaccard-stars").df
    # each node meets one leader first, the same for most of a class
    first = Stored(stars.groupBy("b").agg(F.min(F.struct("own", "a")).alias("l")).select(F.col("l.a").alias("a"), "b"), "jaccard-first").df
    edges = Stored(verified(first, sets, num, den), "jaccard-edges").df
    cc = _classes(edges, "jaccard-classes")
    rest = Stored(_apart(stars.select("a", "b").join(first, ["a", "b"], "left_anti"), cc), "jaccard-second").df
    edges, cc = _more_edges(edges, cc, rest, sets, num, den)
    done = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = Stored(_between(shared.df.select("key", "v", "n", "room"), cc, num, den).join(done, ["a", "b"], "left_anti"), "jaccard-third").df
    shared.drop()
    return _more_edges(edges, cc, rest, sets, num, den)


def _more_edges(edges: DataFrame, cc: DataFrame, pairs: DataFrame, sets: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    if not pairs.limit(1).count():
        return edges, cc
    found = Stored(verified(pairs, sets, num, den), "jaccard-found").df
    if not found.limit(1).count():
        return edges, cc
    edges = edges.unionByName(found)
    return edges, _classes(edges, "jaccard-classes")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, num: int = 75, den: int = 100, rare_most: int = RARE_MOST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, n_shingles, copies, component_id) for every row; links need num/den similarity."""
    return _labelled(docs, key, text, k, num, den, rare_most, block_bytes).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("_n").alias("copies"), F.col("_class").alias("component_id"))


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, num: int = 75, den: int = 100, rare_most: int = RARE_MOST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row of each class, that of the smallest id, with all its columns.

    Rows go by id and text together, so another text of a dropped row's id
    stays. Rows without words stay, and so do rows without an id unless a row
    with an id has their words.
    """
    found = Stored(_labelled(docs, key, text, k, num, den, rare_most, block_bytes), "jaccard-decisions").df
    goes = F.col("n").cast("boolean") & F.col("_class").isNotNull() & ~F.col("id").eqNullSafe(F.col("_class"))
    drop = Stored(found.filter(goes).select(F.col("id").alias("_i"), F.col("h").alias("_h")).distinct(), "jaccard-drop").df
    # rows travel as one column, so that no column of theirs can clash
    marked = docs.select(F.struct(*docs.columns).alias("_all"), F.col(key).cast("long").alias("_id"), F.xxhash64(F.col(text)).alias("_t"))
    kept = marked.join(if_small(drop, 1_000_000), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_t") == F.col("_h")), "left_anti")
    stay = found.filter(~goes & F.col("n").cast("boolean") & F.col("id").isNotNull())
    if not stay.groupBy("id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").limit(1).count():
        return kept.select("_all.*")
    # a representative's row may be repeated, or its words stand in several texts of one id
    again = Stored(stay.groupBy("id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("id"), "jaccard-repeats").df
    few = if_small(again, 1_000_000)
    single = kept.join(few, kept["_id"] == again["id"], "left_anti")
    return single.unionByName(kept.join(few, kept["_id"] == again["id"], "left_semi").dropDuplicates(["_id", "_t"])).select("_all.*")


__all__ = ["near_duplicates", "representatives"]

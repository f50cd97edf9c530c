"""Prefix trie of conversations, family by family first.

The first h turns of a conversation c are replaced by those of its base
conversation, c - c % 20, with h = crc32(c) % 4; a family is a base and what is
built on it. Method: turns (as digests, texts are not shuffled) are cogrouped with
the heads of their base; a task rebuilds a family's conversations and builds its
small trie. Only the combined nodes of families are shuffled: a node is known by its
path's digest, so equal nodes of different families meet in one aggregation
with partial sums. A second pass over the stored family nodes sums subtrees in the same way.

A path's digest is the sum of digests of (depth, role, text) over its turns, 124
bits in four parts, so a family larger than ``family_turns`` rows, which no task should
hold, takes another exact way to the same nodes: its turns are numbered and summed by
``operators.scan`` over range partitions. Different paths of one digest would count as one.

Subtrees need no walk. A node belongs to its smallest member, and what a
conversation owns is the end of its path, from depth s on. Of the words below a
node, every member m adds all of its own less those in nodes it owns, so the sum over a subtree is a sum over the members of the node: of K
- P, where P are the words before the node and K the words before depth s for an owner, all words for other
members; the node's own owner adds nothing. Leaves are counted at the
conversation that owns them. Ids that end in a node are joined in
range partitions and hashed as a stream, so a node with any number of ends is never held whole.

NULL roles and texts count as empty, NULL turns come first; turns that tie are ordered by
role, then by digest. Rows without conv_id are one conversation without a base, whose
id is NULL: the smallest member of a node only if it is the only one, and in no digest of ends.
Repeated rows are repeated turns. Texts of any length count whole. An empty table has no node.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scan import numbered
from ..session import Stored
from .common import WORD, hot_join, if_small, lean
from .shingles import _scramble

#: Conversations c and c - c % BASE_EVERY share a family; heads have fewer than HEADS turns.
BASE_EVERY, HEADS = 20, 4
#: Rows (under 100 bytes each) of a family that one task may hold.
FAMILY_TURNS = 100_000
#: Families beyond that are broadcast up to this number.
HOT_BROADCAST = 100_000
#: Ids joined into one piece before they are hashed.
CHUNK_IDS = 10_000
SUMS = ["s1", "s2", "s3", "s4"]
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def mixed(depth: np.ndarray, x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
    """Digest of a turn at a depth: four rows of 31 bits."""
    a = _scramble(x1.view(np.uint64) * _C[0] + _scramble(x2.view(np.uint64) + depth.astype(np.uint64) * _C[1]))
    b = _scramble(a * _C[2] + x2.view(np.uint64))
    low, up = np.uint64((1 << 31) - 1), np.uint64(33)
    return np.stack([a & low, a >> up, b & low, b >> up]).astype(np.int64)


def light_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(fam, conv, turn, role, x1, x2, words, h): a turn without its text."""
    c = F.col(conv).cast("long")
    plain = conversations.select(c.alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return plain.select(
        family_of(F.col("conv")).alias("fam"), "conv", "turn", "role", F.xxhash64("role", "text").alias("x1"), F.xxhash64(F.lit(97), "role", "text").alias("x2"),
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"), F.coalesce((F.crc32(F.col("conv").cast("string")) % HEADS).cast("long"), F.lit(0)).alias("h"),
    )


def family_of(conv: Column) -> Column:
    return F.coalesce((conv - conv % BASE_EVERY).cast("string"), F.lit("null"))


_ORDER = [("conv", "ascending"), ("turn", "ascending"), ("role", "ascending"), ("x1", "ascending"), ("x2", "ascending")]
_NODES = pa.schema([("fam", pa.string()), ("node", pa.int64()), ("parent", pa.int64()), ("depth", pa.int64()), *[(s, pa.int64()) for s in SUMS], *[(f"p{s}", pa.int64()) for s in SUMS], ("conv", pa.int64()), ("n", pa.int64()), ("words", pa.int64()), ("pre", pa.int64()), ("ends", pa.list_(pa.int64()))])
_NODES_DDL = "fam string, node long, parent long, depth long, " + ", ".join(f"{s} long" for s in SUMS) + ", " + ", ".join(f"p{s} long" for s in SUMS) + ", conv long, n long, words long, pre long, ends array<long>"


def _family(key: tuple, heads: pa.Table, turns: pa.Table) -> pa.Table:
    """The trie of one family; parents come before their children, and the first conversation of a node is its smallest."""
    if not turns.num_rows:
        return _NODES.empty_table()
    sort = lambda t: t.take(pc.sort_indices(t, sort_keys=_ORDER, null_placement="at_start"))
    heads, turns = sort(heads).slice(0, HEADS - 1), sort(turns)
    column = lambda t, c: t.column(c).to_numpy()
    hx = [column(heads, c) for c in ("x1", "x2", "words")]
    tx = [column(turns, c) for c in ("x1", "x2", "words")]
    h, convs = column(turns, "h"), turns.column("conv").to_pylist()
    starts = [i for i in range(len(convs)) if not i or convs[i] != convs[i - 1]]
    trie: dict[tuple[int, int, int], int] = {}
    # parent, depth, sums, conv, members, words, words up to the node, ends
    nodes: list[list] = [[None, 0, (0, 0, 0, 0), convs[0], 0, 0, 0, []]]
    for a, b in zip(starts, [*starts[1:], len(convs)], strict=True):
        c, own = convs[a], min(a + int(h[a]), b)
        x1, x2, words = (np.concatenate([p[: h[a]], q[own:b]]) for p, q in zip(hx, tx, strict=True))
        sums = np.cumsum(mixed(np.arange(1, len(x1) + 1), x1, x2), axis=1).T.tolist()
        at = 0
        nodes[0][4] += 1
        for depth, (k1, k2, w, s) in enumerate(zip(x1.tolist(), x2.tolist(), words.tolist(), sums, strict=True), 1):
            child = trie.setdefault((at, k1, k2), len(nodes))
            if child == len(nodes):
                nodes.append([at, depth, tuple(s), c, 0, w, nodes[at][6] + w, []])
            nodes[child][4] += 1
            at = child
        nodes[at][7].append(c)
    parents = [nodes[n[0]][2] if n[0] is not None else (None,) * 4 for n in nodes]
    cols = [[key[0].as_py()] * len(nodes), range(len(nodes)), [n[0] for n in nodes], [n[1] for n in nodes], *zip(*[n[2] for n in nodes], strict=True), *zip(*parents, strict=True), *[[n[i] for n in nodes] for i in (3, 4, 5, 6, 7)]]
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, _NODES, strict=True)], schema=_NODES)


_BELOW = pa.schema([*[(s, pa.int64()) for s in SUMS], ("depth", pa.int64()), ("saved", pa.int64()), ("leaves", pa.int64())])


def _below(key: tuple, nodes: pa.Table, owners: pa.Table) -> pa.Table:
    """What a family's members add to the subtrees of its nodes."""
    owned = {r["conv"]: r for r in owners.to_pylist()}
    rows = sorted(nodes.to_pylist(), key=lambda r: r["node"])
    k, leaves = [0] * len(rows), [0] * len(rows)
    saved = [0] * len(rows)
    for i in range(len(rows) - 1, -1, -1):
        r = rows[i]
        for c in r["ends"]:
            o = owned.get(c)
            k[i] += o["before"] if o else r["pre"]
            leaves[i] += o["leaf"] if o else 0
        before, o = r["pre"] - r["words"], owned.get(r["conv"])
        saved[i] = k[i] - r["n"] * before + (before - o["before"] if o and o["depth"] <= r["depth"] else 0)
        if i:
            k[r["parent"]] += k[i]
            leaves[r["parent"]] += leaves[i]
    return pa.Table.from_arrays([*[pa.array([r[s] for r in rows], pa.int64()) for s in [*SUMS, "depth"]], pa.array(saved, pa.int64()), pa.array(leaves, pa.int64())], schema=_BELOW)


def _large_rows(turns: DataFrame) -> DataFrame:
    """(conv, depth, sums, parents' sums, words, pre) of the rebuilt conversations of large families, depth 0 included, by scans over range partitions."""
    order = [F.col("turn").asc_nulls_first(), *[F.col(c).asc() for c in ("role", "x1", "x2")]]
    own = Stored(numbered(turns, ["conv"], order), "trie-numbered").df
    heads = own.filter(F.col("conv").cast("string") == F.col("fam")).filter(F.col("_row") < HEADS)
    heads = heads.select("fam", F.col("_row").alias("depth"), "x1", "x2", "words")
    lengths = heads.groupBy("fam").agg(F.max("depth").alias("_heads"))
    # a family has at most two times BASE_EVERY conversations
    convs = own.groupBy("fam", "conv").agg(F.max("h").alias("h"), F.count(F.lit(1)).alias("_turns")).join(lengths, "fam", "left")
    convs = Stored(convs.withColumn("_lead", F.least("h", F.coalesce("_heads", F.lit(0)))).withColumn("_c", F.coalesce(F.col("conv").cast("string"), F.lit(""))), "trie-convs").df
    first = convs.join(heads, "fam").filter(F.col("depth") <= F.col("h")).select("conv", "depth", "x1", "x2", "words")
    late = own.filter(F.col("_row") > F.col("h")).withColumn("_c", F.coalesce(F.col("conv").cast("string"), F.lit("")))
    late = hot_join(late, convs.select("_c", "_lead", "_turns"), ["_c"], "_turns", max(own.count(), 1)).select("conv", (F.col("_lead") + F.col("_row") - F.col("h")).alias("depth"), "x1", "x2", "words")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = mixed(*(b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(x) for x in m], b.column(4)], names=["conv", "depth", "m1", "m2", "m3", "m4", "words"])

    turned = first.unionByName(late).mapInArrow(lean(digest), "conv long, depth long, m1 long, m2 long, m3 long, m4 long, words long")
    sums = {f"m{i}": f"s{i}" for i in range(1, 5)}
    rows = numbered(turned, ["conv"], [F.col("depth").asc()], {**sums, "words": "pre"}).select("conv", "depth", *SUMS, *[(F.col(f"s{i}") - F.col(f"m{i}")).alias(f"ps{i}") for i in range(1, 5)], "words", "pre")
    roots = convs.select("conv", F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(s) for s in SUMS], *[F.lit(None).cast("long").alias(f"p{s}") for s in SUMS], F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("pre"))
    return rows.unionByName(roots)


def _large_nodes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows marked if they end their conversation, and (conv, total, rows) of every conversation."""
    per = Stored(rows.groupBy("conv").agg(F.max("depth").alias("_last"), F.max("pre").alias("total"), F.count(F.lit(1)).alias("_rows")).withColumn("_c", F.coalesce(F.col("conv").cast("string"), F.lit(""))).drop("conv"), "trie-conv-totals").df
    both = rows.withColumn("_c", F.coalesce(F.col("conv").cast("string"), F.lit("")))
    return hot_join(both, per, ["_c"], "_rows", max(rows.count(), 1)).withColumn("_end", F.col("depth") == F.col("_last")), per


def _identity(prefix: str, depth: Column) -> list[Column]:
    """128 bits of a path's sums and depth; NULL above the root."""
    sums = [F.col(f"{prefix}{s}") for s in SUMS]
    return [F.when(sums[0].isNotNull(), F.xxhash64(F.lit(seed), depth, *sums)) for seed in (1, 2)]


def ends_digests(ends: DataFrame) -> DataFrame:
    """(i1, i2, ends_sha256) over rows (i1, i2, conv): ids joined in order within range partitions, then hashed as a stream of pieces."""
    ordered = ends.repartitionByRange("i1", "i2", "conv").sortWithinPartitions("i1", "i2", "conv")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def piece() -> tuple:
            return (*key, held[0], ",".join(map(str, held)))

        for b in batches:
            out = []
            for i1, i2, c in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if held and (key != (i1, i2) or len(held) >= CHUNK_IDS):
                    out.append(piece())
                    held = []
                key = (i1, i2)
                held.append(c)
            yield _batch(out, [pa.int64(), pa.int64(), pa.int64(), pa.string()], ["i1", "i2", "first", "piece"])
        if held:
            yield _batch([piece()], [pa.int64(), pa.int64(), pa.int64(), pa.string()], ["i1", "i2", "first", "piece"])

    pieces = ordered.mapInArrow(lean(join), "i1 long, i2 long, first long, piece string")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for b in batches:
            out = []
            for i1, i2, piece in zip(*(b.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if key == (i1, i2):
                    sha.update(b",")
                else:
                    if key is not None:
                        out.append((*key, sha.hexdigest()))
                    key, sha = (i1, i2), hashlib.sha256()
                sha.update(piece.encode())
            yield _batch(out, [pa.int64(), pa.int64(), pa.string()], ["i1", "i2", "ends_sha256"])
        if key is not None:
            yield _batch([(*key, sha.hexdigest())], [pa.int64(), pa.int64(), pa.string()], ["i1", "i2", "ends_sha256"])

    return pieces.repartition("i1", "i2").sortWithinPartitions("i1", "i2", "first").mapInArrow(lean(digest), "i1 long, i2 long, ends_sha256 string")


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", family_turns: int = FAMILY_TURNS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    light = Stored(light_turns(conversations, conv, turn, role, text), "trie-turns").df
    large = Stored(light.groupBy("fam").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > family_turns).select("fam"), "trie-large").df
    any_large = large.limit(1).count() > 0
    small = light.join(if_small(large, HOT_BROADCAST), "fam", "left_anti") if any_large else light
    bases = small.filter(F.col("conv").cast("string") == F.col("fam"))
    heads = bases.select(*[F.col(c).alias(c) for c in bases.columns])
    built = heads.groupBy("fam").cogroup(small.groupBy("fam")).applyInArrow(_family, _NODES_DDL)
    families = Stored(built, "trie-families").df
    parts = families.select("depth", *SUMS, *[f"p{s}" for s in SUMS], "conv", "n", "words", "pre")
    ends = families.select("depth", *SUMS, F.explode("ends").alias("conv"))
    if any_large:
        rows = Stored(_large_rows(light.join(if_small(large, HOT_BROADCAST), "fam", "left_semi")), "trie-large-rows").df
        big, per = _large_nodes(rows)
        big = Stored(big, "trie-large-nodes").df
        parts = parts.unionByName(big.select("depth", *SUMS, *[f"p{s}" for s in SUMS], "conv", F.lit(1).cast("long").alias("n"), "words", "pre"))
        ends = ends.unionByName(big.filter("_end").select("depth", *SUMS, "conv"))
    i1, i2 = _identity("", F.col("depth"))
    p1, p2 = _identity("p", F.col("depth") - 1)
    merged = parts.select(i1.alias("i1"), i2.alias("i2"), p1.alias("p1"), p2.alias("p2"), "depth", "conv", "n", "words", "pre").groupBy("i1", "i2")
    nodes = Stored(merged.agg(*[F.first(c).alias(c) for c in ("p1", "p2")], F.max("depth").alias("depth"), F.min("conv").alias("conv"), F.sum("n").alias("n"), F.max("words").alias("words"), F.max("pre").alias("pre")), "trie-nodes").df
    children = Stored(nodes.filter("p1 is not null").groupBy(F.col("p1").alias("i1"), F.col("p2").alias("i2")).agg(F.count(F.lit(1)).alias("n_children")), "trie-children").df
    childless = nodes.join(children, ["i1", "i2"], "left").select("conv", "depth", (F.col("pre") - F.col("words")).alias("_before"), F.col("n_children").isNull().cast("long").alias("_leaf"))
    # the end of a path is owned from the smallest such depth on
    owners = Stored(childless.groupBy("conv").agg(F.min("depth").alias("depth"), F.min("_before").alias("before"), F.max("_leaf").alias("leaf"), F.count(F.lit(1)).alias("_chain")).withColumn("fam", family_of(F.col("conv"))), "trie-owners").df
    below = families.groupBy("fam").cogroup(owners.select("fam", "conv", "depth", "before", "leaf").groupBy("fam")).applyInArrow(_below, ", ".join(f"{s} long" for s in SUMS) + ", depth long, saved long, leaves long")
    if any_large:
        # a conversation that owns nothing has no row among owners
        own = owners.select(F.coalesce(F.col("conv").cast("string"), F.lit("")).alias("_c"), "before", "leaf")
        per = Stored(per.join(own, "_c", "left"), "trie-large-owners").df
        mine = hot_join(big.select("_c", "depth", *SUMS, "words", "pre"), per.select("_c", "total", "_rows", "before", "leaf"), ["_c"], "_rows", max(big.count(), 1))
        upto = F.col("pre") - F.col("words")
        gain = F.when(F.col("before").isNull(), F.col("total")).otherwise(F.greatest("before", upto)) - upto
        below = below.unionByName(mine.select(*SUMS, "depth", gain.alias("saved"), F.coalesce("leaf", F.lit(0)).cast("long").alias("leaves")))
    sums = below.groupBy(i1.alias("i1"), i2.alias("i2")).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    digests = ends_digests(ends.filter("conv is not null").select(i1.alias("i1"), i2.alias("i2"), "conv"))
    blank = hashlib.sha256().hexdigest()
    full = nodes.join(children, ["i1", "i2"], "left").join(sums, ["i1", "i2"]).join(digests, ["i1", "i2"], "left")
    full = Stored(full, "trie-full").df
    above = full.filter("n_children is not null").select(F.col("i1").alias("p1"), F.col("i2").alias("p2"), F.col("conv").alias("_up"), F.col("n_children").alias("_hot"))
    total = max(full.count(), 1)
    placed = hot_join(full.filter("p1 is not null"), above, ["p1", "p2"], "_hot", total).unionByName(full.filter("p1 is null").withColumn("_up", F.lit(None).cast("long")).withColumn("_hot", F.lit(None).cast("long")))
    return placed.select(
        F.col("conv").alias("conv_id"), "depth", F.col("_up").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(blank)).alias("ends_sha256"),
    )

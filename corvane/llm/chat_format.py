"""Chat formatting by token-level assembly.

Every segment (the text of a turn) is escaped and encoded by itself; reserved
ids for the turn's header and end are spliced around it. Loss masks are spans
of token positions from prefix sums of the segments' lengths. Content can
never produce a reserved id, since those lie beyond the vocabulary.

A control string in a text gets a backslash before it; unescaping removes one
backslash before each control string, so texts that already hold escaped
control strings come back unchanged.

Turns are ordered by (turn, role, text's digest), NULLs first. A NULL text is empty, a
NULL role the empty role; unknown roles are named in the header. Turns of a NULL
conversation are one conversation. Repeated rows are repeated turns. Texts of any length are encoded
whole; an empty table gives an empty result. Extra columns are ignored, whatever their names. Encoding
happens before the rows of a conversation meet; offsets are prefix sums over range
partitions, and reading back streams through sorted rows, so a conversation of any length needs
the memory of one batch.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scan import numbered
from .common import bounded_batches, lean

#: Roles with a header of their own, and the strings that control the format (fixed values).
ROLES = {"system": "### System:", "user": "### User:", "assistant": "### Assistant:"}
OTHER = "### Role "
END = "</turn>"
CONTROLS = [*ROLES.values(), OTHER, END]
_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROLS, key=len, reverse=True)))
_ESCAPED = re.compile(r"\\(" + _CONTROL.pattern + ")")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m.group(0), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m.group(1), text)


class Codec:
    """Vocabulary of a rank file plus reserved ids after its last one."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.enc = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        first = max(table.values()) + 1
        self.head = {r: first + i for i, r in enumerate(ROLES)}
        self.other, self.colon, self.end = first + 3, first + 4, first + 5
        self.text = {self.head[r]: f"{h}\n" for r, h in ROLES.items()} | {self.other: OTHER, self.colon: ":\n", self.end: f"\n{END}\n"}

    def encode(self, role: str, text: str) -> tuple[list[int], list[int]]:
        """Header ids and content ids of a turn."""
        body = self.enc.encode_ordinary(escape(text))
        if role in self.head:
            return [self.head[role]], body
        return [self.other, *self.enc.encode_ordinary(escape(role)), self.colon], body

    def decode(self, ids: list[int]) -> str:
        """Text of a token sequence, reserved ids as their strings; runs of ordinary ids are decoded together."""
        out, run = [], []
        for i in ids:
            if i in self.text:
                out.append(self.enc.decode_bytes(run).decode("utf-8", "replace"))
                out.append(self.text[i])
                run = []
            else:
                run.append(i)
        out.append(self.enc.decode_bytes(run).decode("utf-8", "replace"))
        return "".join(out)


def encoded_turns(turns: DataFrame, ranks: bytes, pattern: str, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, ids, n_head, n_body): each turn's tokens, before any turns meet."""
    spark = turns.sparkSession
    bounded_batches(spark, 2000)
    shared = spark.sparkContext.broadcast((ranks, pattern))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(*shared.value)
        for b in batches:
            ids, heads, bodies = [], [], []
            for r, t in zip(b["role"], b["text"], strict=True):
                h, body = codec.encode(r, t)
                ids.append([*h, *body, codec.end])
                heads.append(len(h))
                bodies.append(len(body))
            yield pd.DataFrame({"conv": b["conv"], "turn": b["turn"], "role": b["role"], "key": b["text"].map(lambda t: hashlib.md5(t.encode()).hexdigest()), "ids": ids, "n_head": heads, "n_body": bodies})

    plain = turns.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # NULL ids travel as text, since a pandas column of integers has none
    plain = plain.select(F.col("conv").cast("string").alias("conv"), F.col("turn").cast("string").alias("turn"), "role", "text")
    done = plain.mapInPandas(lean(run), "conv string, turn string, role string, key string, ids array<int>, n_head int, n_body int")
    return done.select(F.col("conv").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), "role", "key", "ids", "n_head", "n_body")


def assemble(encoded: DataFrame) -> DataFrame:
    """Turns in order with their token offset and, for assistants, the loss span [mask_from, mask_to) in the conversation.

    Offsets are prefix sums of token counts over range partitions (``operators.scan``), so a
    conversation of any number of turns is split; then its turns stand in order in one partition, to be streamed.
    """
    sized = encoded.withColumn("_tokens", F.size("ids").cast("long"))
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("key").asc()]
    placed = numbered(sized, ["conv"], order, {"_tokens": "_upto"})
    start, body = F.col("_upto") - F.col("_tokens"), F.when(F.col("role") == "assistant", F.col("n_body")).otherwise(F.lit(0))
    spans = placed.select(
        F.coalesce(F.col("conv").cast("string"), F.lit("")).alias("conv"), (F.col("_row") - 1).cast("long").alias("place"), start.alias("start"),
        (start + F.col("n_head")).alias("mask_from"), (start + F.col("n_head") + body).alias("mask_to"), "ids",
    )
    return spans.repartition("conv").sortWithinPartitions("conv", "place")


def read_back(assembled: DataFrame, ranks: bytes, pattern: str, conv: str = "conv_id") -> DataFrame:
    """Digests of every conversation, read from its tokens and masks alone. Needs the order ``assemble`` gives."""
    shared = assembled.sparkSession.sparkContext.broadcast((ranks, pattern))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(*shared.value)
        by_id = {v: k for k, v in codec.head.items()}
        last, state = None, None

        def close():
            return (last, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for b in batches:
            out = []
            for c, start, lo, hi, ids in zip(b["conv"], b["start"], b["mask_from"], b["mask_to"], b["ids"], strict=True):
                if state is None or c != last:
                    if state is not None:
                        out.append(close())
                    last, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids = [int(i) for i in ids]
                if ids[0] in by_id:
                    role, body = by_id[ids[0]], ids[1:-1]
                else:
                    cut = ids.index(codec.colon)
                    role, body = unescape(codec.decode(ids[1:cut])), ids[cut + 1 : -1]
                text = unescape(codec.decode(body))
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                loss = unescape(codec.decode(ids[lo - start : hi - start])) if hi > lo else ""
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(codec.decode(ids))
            yield pd.DataFrame(out, columns=["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        if state is not None:
            yield pd.DataFrame([close()], columns=["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    done = assembled.mapInPandas(lean(run), "conv string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return done.select(F.when(F.col("conv") != "", F.col("conv")).cast("long").alias(conv), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")

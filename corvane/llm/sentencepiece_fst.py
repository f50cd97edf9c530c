"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The model file is compiled into three machines: the normaliser (character map,
escaped spaces, dummy prefix), the pieces (a trie of arcs over their characters, a
final state per piece) and the byte fallback (an arc that reads a character
without a piece and writes its bytes). They are composed with an input
lazily, position by position, and the path of least weight in the tropical
semiring (weights add along a path, the least path counts) is the encoding.

For a unigram model an arc weighs minus its piece's score, the fallback 10
more than the worst piece; a state is a position. For a merge (BPE) model
weights of single pieces cannot express the merge order, so a state is a
position with the piece that led there, and an arc weighs 0 if merging the
joined text of the two pieces gives just these two, else infinity. A sequence whose
neighbours all agree is the merge result, so the one path of finite weight is
the encoding (states of equal weight are expanded farthest first); an input without one is an error, never another encoding.
Conditions are computed on demand and remembered.

The composed machine falls apart where no piece spans two characters; such
cuts (before a space mark that follows another character, around line ends)
give segments, whose shortest paths are remembered. Both tables are bounded in
bytes and keep what was used last.

NULL and empty texts have no tokens and decode to "". The space mark U+2581
decodes to a space, as in the library. Any text length is processed whole.
Repeated rows give repeated rows, and rows do not affect each other. An empty table gives an empty
table. Columns of ``keep`` named like a result column are replaced by it.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORKER_TABLES, bounded_batches, lean

MARK = "▁"
MODEL_BYTES = 16 << 20
#: Bytes of remembered words and of their parts (in each of two generations), and places for remembered neighbour conditions (8 bytes each).
WORD_BYTES, PART_BYTES, PAIRS = 16 << 20, 64 << 20, 1 << 20
#: Label of a fallback arc in a path.
FALLBACK = -2


def load_model(path: str) -> bytes:
    """The file's bytes; its size is checked, as it goes to every executor."""
    if os.path.getsize(path) > MODEL_BYTES:
        raise ValueError("model file too large to broadcast")
    with open(path, "rb") as f:
        return f.read()


def _charsmap(blob: bytes) -> dict[str, str]:
    """Rewrites of a precompiled character map: a double-array trie over UTF-8 bytes, then its replacement texts."""
    if not blob:
        return {}
    (size,) = struct.unpack_from("<I", blob)
    units = struct.unpack_from(f"<{size // 4}I", blob, 4)
    texts = blob[4 + size :]
    offset = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
    out: dict[str, str] = {}
    stack = [(0, b"")]
    while stack:
        pos, prefix = stack.pop()
        base = pos ^ offset(units[pos])
        for c in range(1, 256):
            nxt = base ^ c
            if nxt >= len(units) or units[nxt] & ((1 << 31) | 0xFF) != c:
                continue
            if units[nxt] & (1 << 8):
                value = units[nxt ^ offset(units[nxt])] & ((1 << 31) - 1)
                out[(prefix + bytes([c])).decode("utf-8", "ignore")] = texts[value : texts.index(b"\0", value)].decode()
            stack.append((nxt, prefix + bytes([c])))
    return out


class Remembered(dict):
    """Results of ``find`` by segment; when the bytes of a generation are used up, it becomes the old one and the one before goes."""

    def __init__(self, find, most: int):
        super().__init__()
        self.find, self.most, self.held, self.old = find, most, 0, {}

    def __missing__(self, segment: str) -> tuple[int, ...]:
        got = self.old.get(segment)
        if got is None:
            got = self.find(segment)
        size = 4 * len(segment) + 8 * len(got) + 200
        if size > self.most >> 4:
            return got
        self.held += size
        if self.held > self.most:
            self.old = dict(self)
            self.clear()
            self.held = size
        self[segment] = got
        return got


class Transducer:
    """Compiled machines of one model."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(model)
        spec, kinds = m.normalizer_spec, pb.ModelProto.SentencePiece
        self.bpe = m.trainer_spec.model_type == pb.TrainerSpec.BPE
        if not self.bpe and m.trainer_spec.model_type != pb.TrainerSpec.UNIGRAM:
            raise ValueError("only merge and unigram models")
        self.dummy, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.rewrites = _charsmap(spec.precompiled_charsmap)
        self.rewrite = re.compile("|".join(re.escape(k) for k in sorted(self.rewrites, key=len, reverse=True))) if self.rewrites else None
        self.ids: dict[str, int] = {}
        self.score: list[float] = []
        self.bytes = [-1] * 256
        self.unk = 0
        self.out: list[bytes] = []
        for i, p in enumerate(m.pieces):
            self.score.append(p.score)
            if p.type == kinds.BYTE:
                value = int(p.piece[1:-1], 16)
                self.bytes[value] = i
                self.out.append(bytes([value]))
            elif p.type in (kinds.NORMAL, kinds.USER_DEFINED):
                self.ids[p.piece] = i
                self.out.append(p.piece.replace(MARK, " ").encode())
            elif p.type == kinds.UNKNOWN:
                self.unk = i
                self.out.append(m.trainer_spec.unk_surface.encode())
            else:
                self.out.append(b"")
        self.piece = {i: p for p, i in self.ids.items()}
        self.size = {i: len(p) for i, p in self.piece.items()}
        # the trie: a state is a table of arcs, its piece under the empty label
        self.root: dict = {}
        for p, i in self.ids.items():
            state = self.root
            for c in p:
                state = state.setdefault(c, {})
            state[""] = i
        # may a text be cut before a mark, and on both sides of a line end?
        self.cut_mark = not any(b == MARK and a != MARK for p in self.ids for a, b in zip(p, p[1:], strict=False))
        self.cut_line = not any("\n" in p for p in self.ids if len(p) > 1)
        # neighbours that some piece holds; between others the machine falls apart
        self.spanned = frozenset(a + b for p in self.ids for a, b in zip(p, p[1:], strict=False))
        self.worst = 10.0 - min((self.score[i] for i in self.ids.values()), default=0.0)
        # 2 (condition's key) + (its answer) at a place that the key's hash gives; a later key takes the place
        self._pairs = array("q", [-1]) * PAIRS
        self._built: dict[int, tuple[list[float], list[str], list[str]]] = {}
        self._words = Remembered(self._word, WORD_BYTES)
        self._runs = Remembered(self._path, PART_BYTES)
        self.line = self._path("\n")

    def normalize(self, text: str) -> str:
        """The normaliser's output, spaces escaped, without the dummy prefix."""
        if self.rewrite is not None:
            text = self.rewrite.sub(lambda x: self.rewrites[x.group(0)], text)
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        return text.replace(" ", MARK)

    def _fallback(self, c: str) -> list[int]:
        got = [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")]
        return [self.unk] if -1 in got else got

    def _steps(self, t: int) -> tuple[list[float], list[str], list[str]]:
        """Merges that build a piece in order: their scores, and the piece at the left and at the right edge before each and at the end."""
        known = self._built.get(t)
        if known is None:
            part, scores = list(self.piece[t]), []
            left, right = [part[0]], [part[-1]]
            while len(part) > 1:
                best, at = None, -1
                for i in range(len(part) - 1):
                    j = self.ids.get(part[i] + part[i + 1])
                    if j is not None and (best is None or self.score[j] > best):
                        best, at = self.score[j], i
                if best is None:
                    break
                part[at : at + 2] = [part[at] + part[at + 1]]
                scores.append(best)
                left.append(part[0])
                right.append(part[-1])
            known = self._built[t] = (scores, left, right)
        return known

    def _agree(self, a: int, b: int) -> bool:
        """Whether two pieces may stand side by side in a merge model; FALLBACK is a start or a character without a piece.

        Both pieces are built merge by merge, the better next merge first, the
        left one among equals; they agree if no merge across their border is
        ever the best.
        """
        if a == FALLBACK:
            return self._whole(b)
        (sa, _, ra), (sb, lb, _) = self._steps(a), self._steps(b)
        if ra[-1] != self.piece[a] or lb[-1] != self.piece[b]:
            return False
        ids, score, i, j = self.ids, self.score, 0, 0
        low = float("-inf")
        while True:
            x = ids.get(ra[i] + lb[j])
            across = low if x is None else score[x]
            na = sa[i] if i < len(sa) else None
            y = sb[j] if j < len(sb) else None
            if na is not None and (y is None or na >= y) and na >= across:
                i += 1
            elif x is not None and (y is None or across >= y):
                return False
            elif y is not None:
                j += 1
            else:
                return True

    def _whole(self, t: int) -> bool:
        """Whether merging a piece's text gives the piece."""
        return self._steps(t)[1][-1] == self.piece[t]

    def _path(self, s: str) -> tuple[int, ...]:
        """The shortest path of the composed machine over a segment, as piece ids."""
        labels = self._merge_path(s) if self.bpe else self._unigram_path(s)
        if FALLBACK not in labels:
            return tuple(labels)
        out, at = [], 0
        for t in labels:
            out += self._fallback(s[at]) if t == FALLBACK else [t]
            at += 1 if t == FALLBACK else self.size[t]
        return tuple(out)

    def _unigram_path(self, s: str) -> list[int]:
        """States are positions; the relaxation goes through them in order, as all arcs lead forward."""
        n, root, score, inf = len(s), self.root, self.score, float("inf")
        cost, back = [0.0] + [inf] * n, [(0, 0)] * (n + 1)
        for pos in range(n):
            here, state, end, single = cost[pos], root, pos, False
            while end < n:
                state = state.get(s[end])
                if state is None:
                    break
                end += 1
                t = state.get("")
                if t is not None:
                    single = single or end == pos + 1
                    if here - score[t] < cost[end]:
                        cost[end], back[end] = here - score[t], (pos, t)
            if not single and here + self.worst < cost[pos + 1]:
                cost[pos + 1], back[pos + 1] = here + self.worst, (pos, FALLBACK)
        out = []
        while n:
            n, t = back[n]
            out.append(t)
        return out[::-1]

    def _merge_path(self, s: str) -> list[int]:
        """Best-first search over (position, last label): weights are 0 or infinity, so of equal states the farthest goes first.

        A finite path to a position is the merge result of the text before it,
        hence the only one: the first label that reaches a position stays.
        """
        ids, root, pairs, vocabulary, last = self.ids, self.root, self._pairs, len(self.score), PAIRS - 1
        whole = ids.get(s)
        if whole is not None and self._whole(whole):
            return [whole]
        n = end = len(s)
        label: list[int | None] = [None] * (n + 1)
        label[0] = FALLBACK
        arcs: list[tuple[int, int, int]] = []
        here = 0
        while here < n:
            # arcs of the composed machine that leave this position, the longest on top
            state, end = root, here
            while end < n:
                state = state.get(s[end])
                if state is None:
                    break
                end += 1
                if "" in state:
                    arcs.append((here, end, state[""]))
            if s[here] not in ids:
                arcs.append((here, here + 1, FALLBACK))
            while arcs:
                start, end, t = arcs.pop()
                if label[end] is None:
                    agree = True
                    if t != FALLBACK:
                        k = (label[start] + 2) * vocabulary + t
                        place = (k * 0x9E3779B1 >> 9) & last
                        known = pairs[place]
                        agree = known & 1
                        if known >> 1 != k:
                            agree = self._agree(label[start], t)
                            pairs[place] = 2 * k + agree
                    if agree:
                        label[end] = t
                        here = end
                        break
            else:
                raise RuntimeError("the composed machine has no finite path")
        out = []
        while n:
            t = label[n]
            out.append(t)
            n -= 1 if t == FALLBACK else self.size[t]
        return out[::-1]

    def _word(self, word: str) -> tuple[int, ...]:
        """Path of a word behind a space, or of a word behind a line end that it begins with."""
        if word[:1] == "\n":
            return self.line + (self._parts(word[1:]) if len(word) > 1 else ())
        return self._parts(MARK + word)

    def _parts(self, s: str) -> tuple[int, ...]:
        """Path of a segment from those of its parts, cut where no piece spans two characters."""
        spanned, runs, at = self.spanned, self._runs, 0
        out: list[int] = []
        for i in range(1, len(s)):
            if s[i - 1 : i + 1] not in spanned:
                out.extend(runs[s[at:i]])
                at = i
        return (*out, *runs[s[at:]]) if at else runs[s]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        s = text if self.rewrite is None and not self.squeeze else self.normalize(text).replace(MARK, " ")
        if not s:
            return []
        if self.cut_mark and self.cut_line and self.dummy and s[0] != " " and "  " not in s and MARK not in s:
            # every space begins a segment, and so does every line end
            return list(chain.from_iterable(map(self._words.__getitem__, s.replace("\n", " \n").split(" "))))
        s = (MARK if self.dummy else "") + s.replace(" ", MARK)
        if not self.cut_mark:
            return list(self._path(s))
        pieces: list[tuple[int, ...]] = []
        for i, line in enumerate(s.split("\n") if self.cut_line else [s]):
            if i:
                pieces.append(self.line)
            pieces.extend(map(self._runs.__getitem__, re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", line)))
        return list(chain.from_iterable(pieces))

    def decode(self, ids: list[int]) -> str:
        out = self.out
        text = b"".join([out[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.dummy and text.startswith(" ") else text


_compiled: dict[bytes, Transducer] = WORKER_TABLES.setdefault("sentencepiece", {})


def compiled(model: bytes) -> Transducer:
    """The transducer of a model, kept with its bounded tables for the worker process's next task, unless that is another operator's; one model at a time."""
    key = hashlib.sha256(model).digest()
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = Transducer(model)
    return _compiled[key]


RESULTS = ["ids", "n_tokens", "n_byte_tokens", "decoded_sha256", "roundtrip"]


def encode(docs: DataFrame, model: bytes, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default all) and ids, n_tokens, n_byte_tokens, decoded_sha256, roundtrip."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in RESULTS]
    frame = docs.select(*keep, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled(shared.value)
        is_byte = np.zeros(len(t.score), bool)
        is_byte[[b for b in t.bytes if b >= 0]] = True
        for b in batches:
            flat, ends, n_byte, digest, same = [], [0], [], [], []
            total = 0
            for x in b.column(b.num_columns - 1).to_pylist():
                ids = t.encode(x)
                arr = np.fromiter(ids, np.int32, len(ids))
                flat.append(arr)
                total += len(ids)
                ends.append(total)
                n_byte.append(int(is_byte[arr].sum()))
                back = t.decode(ids)
                digest.append(hashlib.sha256(back.encode()).hexdigest())
                same.append(back == (x or "").replace(MARK, " "))
            tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32)))
            n = np.diff(np.array(ends, np.int64))
            cols = [*b.columns[:-1], tokens, pa.array(n), pa.array(n_byte, pa.int64()), pa.array(digest, pa.string()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *RESULTS])

    schema = ", ".join(f"`{c}` {k}" for c, k in docs.select(*keep).dtypes)
    return frame.mapInArrow(lean(run, "sentencepiece"), f"{schema}, ids array<int>, n_tokens long, n_byte_tokens long, decoded_sha256 string, roundtrip boolean")


def decode(tokens: DataFrame, model: bytes, ids: str = "ids", out: str = "text") -> DataFrame:
    """All columns and the decoded text, which replaces a column of its name."""
    shared = tokens.sparkSession.sparkContext.broadcast(model)
    tokens = tokens.drop(out) if out != ids else tokens
    at, names = tokens.columns.index(ids), [*tokens.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([t.decode(x or []) for x in b.column(at).to_pylist()], pa.string())], names=names)

    schema = ", ".join(f"`{c}` {k}" for c, k in tokens.dtypes)
    return tokens.mapInArrow(lean(run, "sentencepiece"), f"{schema}, `{out}` string")

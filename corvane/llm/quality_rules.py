"""Quality rules: word, symbol and repetition counts, and bands on tokeniser fertility.

Two public vocabularies, one of pieces with byte fallback and one of bytes, encode every text; each gives three measures:
characters per token, the share of tokens that are a single byte, and the
entropy of the token distribution over its largest value log2(tokens).

The bands come from the corpus: for every language and size class (doublings of
the number of tokens, as short texts scatter more) and every measure, a text is rejected beyond
``width`` = 2.5 times the distance of the quartiles below the first or above the third quartile
(characters per token on both sides, byte share above, entropy below). That distance counts as 2 % of the
first quartile, or 0.01 for byte shares, at least, so that a measure on which a language's texts
agree rejects nothing for a trifle. Quartiles are read from counts on a grid of 1/1000, over all
texts that pass the base rules and have ``least_tokens``. Groups of fewer than ``least_group`` texts take the bands of their script
(over all languages), and a script with fewer the fixed ones in BANDS. Texts of fewer tokens are judged
by the base rules alone.

NULL texts have no words and fail the base. A NULL or unknown language is one group
by its name. Equal rows judge alike; there are no ties. An empty table gives an empty
result. Texts of any length are counted whole; words beyond ``LONG_WORD``
characters are encoded in parts of that length. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import Stored
from .common import WORD_RE, bounded_batches, hot_join, lean

SYMBOLS = "#*$%&|<>"
#: Bands of scripts with too few texts, on the pieces: least and most characters per token, most byte share, least entropy (fixed values).
BANDS = {"Latin": (1.3, 9.0, 0.15, 0.30), "Other": (0.2, 9.0, 0.90, 0.20)}
MEASURES = ["chars_per_token", "byte_share", "token_entropy", "chars_per_byte_token", "single_byte_share", "byte_token_entropy"]
#: Least distance of the quartiles, as a share of the first or absolute, and the sides on which a measure rejects.
FLOORS = [(0.02, 0.0), (0.0, 0.01), (0.02, 0.0)] * 2
SIDES = [(True, True), (False, True), (True, False)] * 2
GRID = 1000
LEAST_GROUP = 100
WIDTH = 2.5
LONG_WORD = 1000
LEAST_TOKENS = 100
#: Remembered words of a process, when a batch of rows begins.
WORDS = 400_000


def script_of(text: str) -> str:
    """Latin if at least half of the letters of the whole text lie below U+0250, else Other."""
    if text.isascii():
        return "Latin"
    letters = [(c, n) for c, n in Counter(text).items() if c.isalpha()]
    return "Latin" if 2 * sum(n for c, n in letters if c < "ɐ") >= sum(n for _, n in letters) else "Other"


def repeated_words(codes: np.ndarray) -> int:
    """Words inside 3-word windows that occur at least twice."""
    n = len(codes)
    if n < 4:
        return 0
    top = int(codes.max()) + 1
    pair = codes[:-1] * top + codes[1:]
    if top >= 1 << 20:  # three codes would not fit into 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
        top = max(top, n)
    triple = pair[:-1] * top + codes[2:]
    order = np.argsort(triple, kind="stable")
    same = triple[order[1:]] == triple[order[:-1]]
    hit = np.zeros(n - 2, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    mark = np.zeros(n, bool)
    for j in range(3):
        mark[j : n - 2 + j] |= hit
    return int(mark.sum())


def repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if WORD_RE.search(x)]
    return len(lines) - len(set(lines))


def _measures(ids: np.ndarray, single: np.ndarray, chars: int) -> tuple[float | None, float | None, float | None]:
    """Characters per token, share of single bytes, relative entropy of a token sequence."""
    total = len(ids)
    if not total:
        return None, None, None
    every = np.sort(ids)
    cut = np.flatnonzero(every[1:] != every[:-1])
    p = np.diff(cut, prepend=-1, append=total - 1) / total
    entropy = float(-(p * np.log2(p)).sum()) / np.log2(total) if total > 1 else 0.0
    return chars / total, float(single[every].sum()) / total, entropy


def short_words(words: list[str]) -> list[str]:
    """The words, those beyond LONG_WORD characters in parts."""
    if max(map(len, words), default=0) <= LONG_WORD:
        return words
    return [w[i : i + LONG_WORD] for w in words for i in range(0, len(w), LONG_WORD)]


class Fertility:
    """Numbers words and keeps their tokens of both vocabularies in flat arrays, as words are encoded independently.

    The vocabulary of bytes reads a word with one space before it.
    """

    def __init__(self, model: bytes, ranks: bytes, pattern: str):
        import sentencepiece
        import tiktoken

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.enc = tiktoken.Encoding("rules", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        single, self.opens = np.zeros(max(table.values()) + 1, bool), np.zeros(max(table.values()) + 1, bool)
        single[[i for b, i in table.items() if len(b) == 1]] = True
        self.opens[[i for b, i in table.items() if b[:1] == b" "]] = True
        self.byte = np.array([self.sp.is_byte(i) for i in range(self.sp.get_piece_size())]), single
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.length = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.start = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.flat = [np.zeros(0, np.int32), np.zeros(0, np.int32)]

    def _bytes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the words one after the other, and how many each has; a token that begins with a space begins a word."""
        ids = np.array(self.enc.encode_ordinary(" " + " ".join(words)), np.int32)
        first = np.flatnonzero(self.opens[ids])
        if len(first) == len(words) and first[0] == 0:
            return ids, np.diff(first, append=len(ids))
        lists = [self.enc.encode_ordinary(" " + w) for w in words]
        return np.fromiter(chain.from_iterable(lists), np.int32), np.fromiter(map(len, lists), np.int64, len(lists))

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.code]
        if len(self.code) + len(new) > WORDS:
            self.clear()
            new = list(words)
        self.code.update(zip(new, range(len(self.length[0]), len(self.length[0]) + len(new)), strict=True))
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            lists = self.sp.encode(part, num_threads=1)
            pieces = np.fromiter(chain.from_iterable(lists), np.int32), np.fromiter(map(len, lists), np.int64, len(lists))
            for v, (ids, n) in enumerate((pieces, self._bytes(part))):
                self.start[v] = np.concatenate([self.start[v], len(self.flat[v]) + np.cumsum(n) - n])
                self.length[v] = np.concatenate([self.length[v], n])
                self.flat[v] = np.concatenate([self.flat[v], ids])

    def codes(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.code.__getitem__, words), np.int64, len(words))

    def measure(self, codes: np.ndarray, chars: int) -> tuple:
        """The three measures of each vocabulary, and the number of pieces, of a sequence of words."""
        out: list = []
        for start, length, flat, byte in zip(self.start, self.length, self.flat, self.byte, strict=True):
            n = length[codes]
            at = np.arange(int(n.sum())) + np.repeat(start[codes] - (np.cumsum(n) - n), n)
            out += _measures(flat[at], byte, chars)
        return *out, int(self.length[0][codes].sum())


def measured(docs: DataFrame, model: bytes, ranks: bytes, pattern: str, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(_key, counts, base_failed, measures, n_tokens, language, script) of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast((model, ranks, pattern))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    names = ["_key", *counts, "base_failed", *MEASURES, "n_tokens", "language", "script"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fert = Fertility(*shared.value)
        for b in batches:
            cols: list[list] = [[] for _ in names[1:]]
            rows = [(t or "", WORD_RE.findall(t or ""), g) for t, g in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            fert.learn({w for _, ws, _ in rows for w in short_words(ws)})
            for t, ws, g in rows:
                n = len(ws)
                chars = sum(map(len, ws))
                parts = short_words(ws)
                codes = fert.codes(parts)
                rep = repeated_words(codes if parts is ws else np.unique(np.array(ws, object), return_inverse=True)[1])
                bad = n < 50 or 100 * rep > 50 * n
                values = (n, chars, sum(map(t.count, SYMBOLS)), repeated_lines(t), rep, bad, *fert.measure(codes, chars), g, script_of(t))
                for c, v in zip(cols, values, strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 5 + [pa.bool_()] + [pa.float64()] * 6 + [pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=names)

    kind = dict(docs.dtypes)[key]
    schema = ", ".join([f"_key {kind}", *[f"{c} long" for c in counts], "base_failed boolean", *[f"{m} double" for m in MEASURES], "n_tokens long", "language string", "script string"])
    return docs.select(F.col(key), F.col(text), F.col(lang).cast("string")).mapInArrow(lean(run), schema)


def _fences(cells: DataFrame, by: list[str], width: float) -> DataFrame:
    """(by, size, lo_i, hi_i for every measure i): counts on the grid, quartiles, fences."""
    summed = cells.groupBy(*by, "_m", "_bin").agg(F.sum("_c").alias("_c"))
    order = W.partitionBy(*by, "_m").orderBy("_bin")
    cum = summed.withColumn("_cum", F.sum("_c").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("_all", F.sum("_c").over(W.partitionBy(*by, "_m")))
    quartiles = cum.groupBy(*by, "_m").agg(F.min(F.when(F.col("_cum") * 4 >= F.col("_all"), F.col("_bin"))).alias("_q1"), F.min(F.when(F.col("_cum") * 4 >= F.col("_all") * 3, F.col("_bin"))).alias("_q3"), F.max("_all").alias("_n"))
    out = [F.max("_n").alias("_size")]
    for i, (share, least) in enumerate(FLOORS):
        spread = F.greatest(F.col("_q3") - F.col("_q1"), F.col("_q1") * share, F.lit(least * GRID))
        of = F.col("_m") == i
        out += [F.max(F.when(of, (F.col("_q1") - width * spread) / GRID)).alias(f"lo_{i}"), F.max(F.when(of, (F.col("_q3") + 1 + width * spread) / GRID)).alias(f"hi_{i}")]
    return quartiles.groupBy(*by).agg(*out)


def judge(docs: DataFrame, model: bytes, ranks: bytes, pattern: str, key: str = "doc_id", text: str = "text", lang: str = "lang", least_tokens: int = LEAST_TOKENS, least_group: int = LEAST_GROUP, width: float = WIDTH) -> DataFrame:
    """(key, counts, base_failed, fertility measures, band, rejected_by, kept); band names what judged a row, rejected_by the first measure beyond it."""
    rows = Stored(measured(docs, model, ranks, pattern, key, text, lang), "rules-measures").df
    rows = rows.withColumn("language", F.coalesce("language", F.lit(""))).withColumn("_class", F.length(F.bin("n_tokens")))
    judged = (~F.col("base_failed")) & (F.col("n_tokens") >= least_tokens)
    values = F.array(*[F.struct(F.lit(i).alias("_m"), F.floor(F.col(m) * GRID).alias("_bin")) for i, m in enumerate(MEASURES)])
    long = rows.filter(judged).select("language", "script", "_class", F.explode(values).alias("_v")).select("language", "script", "_class", "_v.*")
    # at most a few thousand cells of the grid for each language and class
    cells = Stored(long.groupBy("language", "script", "_class", "_m", "_bin").agg(F.count(F.lit(1)).alias("_c")), "rules-cells").df
    groups = _fences(cells, ["language", "_class"], width).filter(F.col("_size") >= least_group)
    scripts = _fences(cells, ["script"], width).filter(F.col("_size") >= least_group)
    bounds = [f"{side}_{i}" for i in range(len(MEASURES)) for side in ("lo", "hi")]
    fixed = {"lo_0": 0, "hi_0": 1, "hi_1": 2, "lo_2": 3}
    of_script = scripts.select(F.col("script").alias("_script"), *[F.col(b).alias(f"s_{b}") for b in bounds], F.lit(True).alias("_has_script"))
    groups = Stored(groups.withColumn("_has_group", F.lit(True)), "rules-groups").df
    joined = rows.join(F.broadcast(of_script), F.col("script") == F.col("_script"), "left")  # two scripts
    joined = joined.join(F.broadcast(groups), ["language", "_class"], "left") if groups.count() <= 100_000 else hot_join(joined, groups, ["language", "_class"], "_size", rows.count(), "left")
    for b in bounds:
        value = F.when(F.col("script") == "Latin", F.lit(BANDS["Latin"][fixed[b]])).otherwise(F.lit(BANDS["Other"][fixed[b]])) if b in fixed else F.lit(None).cast("double")
        joined = joined.withColumn(b, F.when(F.col("_has_group"), F.col(b)).when(F.col("_has_script"), F.col(f"s_{b}")).otherwise(value))
    reason = F.lit(None).cast("string")
    for i, m in reversed(list(enumerate(MEASURES))):
        low, high = SIDES[i]
        beyond = (F.coalesce(F.col(m) < F.col(f"lo_{i}"), F.lit(False)) & F.lit(low)) | (F.coalesce(F.col(m) > F.col(f"hi_{i}"), F.lit(False)) & F.lit(high))
        reason = F.when(beyond, F.lit(m)).otherwise(reason)
    band = F.when(F.col("_has_group"), F.concat_ws("/", "language", "_class")).when(F.col("_has_script"), F.col("script")).otherwise(F.concat(F.lit("fixed "), F.col("script")))
    out = joined.withColumn("band", F.when(judged, band)).withColumn("rejected_by", F.when(judged, reason))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return out.select(F.col("_key").alias(key), *counts, *MEASURES, "n_tokens", "band", "rejected_by", (~F.col("base_failed") & F.col("rejected_by").isNull()).alias("kept"))

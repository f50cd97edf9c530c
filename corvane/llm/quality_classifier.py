"""Quality classifier: naive Bayes log-count ratios as feature scales of a linear support vector machine.

Features are indicators of hashed n-grams: bytes (1 and 3), byte classes
(4), words (1 and 2), and the pattern of words that repeat one of the two
words before (3). An indicator is scaled by its class log-count ratio, rows
are scaled to length 1, and a hinge-loss model with L2 penalty is fitted by
dual coordinate descent. A logistic curve fitted on a part kept out of the
fit turns margins into probabilities at the labels' own class shares.

The fit uses a bounded sample of labelled rows: at most ``fit_rows`` of each
class, those of smallest digest of the id, and of these so many, in that order, that they hold at most
``fit_features`` features (documented bounds, the same at
every size). Its rows meet in one task; scoring reads every row and whole
text. Ids, languages, sources and labels are no features.

Rows without an id or label are not learned from, but scored. NULL and empty texts
have no n-gram and get the score of the bias. Documents with several labels count
as good if one says so; of documents with several texts the one with the least features in binary order is learned from. Without labels of both classes every score is the
share of good ones (0.5 without any). Repeated rows and ties score alike.
Extra columns are carried; one named like the score is replaced. Texts are read whole, in segments; an empty
table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, lean
from .shingles import _MIX, _words

BITS = 17
SIZE = 1 << BITS
SEGMENT = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0d]")


def _classes() -> np.ndarray:
    c = np.full(256, 1, np.uint8)
    c[ord("a") : ord("z") + 1] = 2
    c[ord("A") : ord("Z") + 1] = 3
    c[ord("0") : ord("9") + 1] = 4
    c[[0x20, 0x09]] = 5
    c[[0x0A, 0x0D]] = 6
    c[128:] = 7
    for x in b"!?.,;:":
        c[x] = x
    for x in b"#*$%&|<>{}[]()_/\\=+~^@":
        c[x] = 8
    return c


_CLASS = _classes()


def _grams(b: np.ndarray, n: int, salt: int, flags: np.ndarray) -> None:
    if len(b) < n:
        return
    h = np.full(len(b) - n + 1, salt * 2654435761 % 2**32, np.uint32)
    for j in range(n):
        h = (h ^ b[j : len(b) - n + 1 + j]) * np.uint32(0x01000193) + np.uint32(0x9E3779B9)
    h ^= h >> np.uint32(15)
    flags[(h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)] = True


def features(text: str | None, flags: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Sorted indices of a text's n-grams; ``flags`` is scratch space of SIZE booleans, left cleared.

    The text is read in segments of about ``segment`` bytes, which bound the memory and do not affect the result.
    """
    if not text:
        return np.zeros(0, np.int32)
    raw, at, seen = text.encode("utf-8", "surrogatepass"), 0, 0
    last = np.zeros(0, np.uint64)
    while at < len(raw):
        # segments end behind a word, and what spans two of them is carried over: 3 bytes and 4 words
        space = _BLANK.search(raw, at + segment)
        end = space.start() if space else len(raw)
        b = np.frombuffer(raw[max(0, at - 3) : end], np.uint8)
        wide, cls = b.astype(np.uint32), _CLASS[b].astype(np.uint32)
        for n in (1, 3):
            _grams(wide, n, n, flags)
        for n in (4,):
            _grams(cls, n, 10 + n, flags)
        w = np.concatenate([last, _words(raw[at:end])[0]])
        new, at = len(w) - len(last), end
        if new:
            flags[(w >> np.uint64(64 - BITS)).astype(np.int64)] = True
            pair = (w[:-1] * _MIX[3] + w[1:]) * _MIX[1]
            flags[(pair >> np.uint64(64 - BITS)).astype(np.int64)] = True
            again = np.zeros(len(w), np.uint32)
            again[1:] |= w[1:] == w[:-1]
            again[2:] |= (w[2:] == w[:-2]).astype(np.uint32) << np.uint32(1)
            # the first two of carried words were judged in the segment before
            _grams(again[2:] if seen > len(last) else again, 3, 20, flags)
            last, seen = w[-4:], seen + new
    found = np.flatnonzero(flags).astype(np.int32)
    flags[found] = False
    return found


def fit(rows: list[np.ndarray], y: np.ndarray, prior: float, alpha: float = 1.0, c: float = 1.0, epochs: int = 12, seed: int = 0) -> dict:
    """Weights (already times the ratios), bias and calibration from indicator rows and labels in {0, 1}."""
    rng = np.random.default_rng(seed)
    n = len(rows)
    hold = rng.random(n) < 0.2
    if len(set(y[hold])) < 2 or len(set(y[~hold])) < 2:
        hold[:] = False
    train = np.flatnonzero(~hold)
    p, q = np.full(SIZE, alpha), np.full(SIZE, alpha)
    for i in train:
        (p if y[i] else q)[rows[i]] += 1
    ratio = (np.log(p / p.sum()) - np.log(q / q.sum())).astype(np.float64)
    scaled, norms = {}, {}
    for i in train:
        v = ratio[rows[i]]
        norms[i] = 1.0 / max(1e-9, float(np.sqrt(v @ v)))
        scaled[i] = v * norms[i]
    w, bias = np.zeros(SIZE), 0.0
    a = np.zeros(n)
    sign = np.where(y > 0, 1.0, -1.0)
    share = np.array([max(1, int((y[train] == 0).sum())), max(1, int((y[train] == 1).sum()))], float)
    upper = c * len(train) / (2 * share)  # each class has half of the total penalty
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(train):
            x, idx = scaled[i], rows[i]
            g = sign[i] * (x @ w[idx] + bias) - 1.0
            new = min(max(a[i] - g / 2.0, 0.0), upper[int(y[i])])  # |x|^2 = 1, and 1 for the bias
            d = (new - a[i]) * sign[i]
            if d:
                w[idx] += d * x
                bias += d
                a[i] = new
                moved = max(moved, abs(d))
        if moved < 1e-3:
            break
    model = {"ratio": ratio.astype(np.float32), "w": w.astype(np.float32), "bias": bias}
    check = np.flatnonzero(hold) if hold.any() else train
    m = np.array([margin(model, rows[i]) for i in check])
    t = y[check].astype(float)
    weight = np.where(t > 0, prior / max(1, t.sum()), (1 - prior) / max(1, (1 - t).sum())) * len(t)
    slope, shift = 1.0, 0.0
    for _ in range(100):  # Newton steps of the two-parameter logistic fit, slightly penalised
        s = 1 / (1 + np.exp(-np.clip(slope * m + shift, -30, 30)))
        r, v = weight * (s - t), weight * np.maximum(s * (1 - s), 1e-6)
        grad = np.array([r @ m + 1e-2 * slope, r.sum()])
        hess = np.array([[v @ (m * m) + 1e-2, v @ m], [v @ m, v.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        slope, shift = slope - np.clip(step[0], -5, 5), shift - np.clip(step[1], -5, 5)
        if abs(step).max() < 1e-8:
            break
    return model | {"slope": float(slope), "shift": float(shift)}


def margin(model: dict, idx: np.ndarray) -> float:
    if not len(idx):
        return float(model["bias"])
    v = model["ratio"][idx]
    return float(v @ model["w"][idx]) / max(1e-9, float(np.sqrt(v @ v))) + float(model["bias"])


def _packed(found: np.ndarray) -> bytes:
    """Indices, or from SIZE / 32 of them on one bit for each; SIZE / 8 bytes at most."""
    if len(found) < SIZE // 32:
        return b"i" + found.tobytes()
    bits = np.zeros(SIZE, np.uint8)
    bits[found] = 1
    return b"b" + np.packbits(bits).tobytes()


def _unpacked(x: bytes) -> bytes:
    return x[1:] if x[:1] == b"i" else np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8, offset=1))).astype(np.int32).tobytes()


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = 3000, fit_features: int = 20_000_000) -> dict:
    """The model of a bounded sample; only its weights (about 1 MB) reach the driver."""
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_id")).agg(F.max(label).cast("int").alias("_y"))
    counts = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    if len(counts) < 2:
        return {"constant": prior}
    order = [F.xxhash64("_id"), F.col("_id")]
    sample = None
    for v in (0, 1):
        some = known.filter(F.col("_y") == v).orderBy(*order).limit(fit_rows)
        sample = some if sample is None else sample.unionByName(some)
    chosen = docs.select(F.col(key).alias("_id"), F.col(text).alias("_t")).join(F.broadcast(sample), "_id")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(SIZE, bool)
        for b in batches:
            x = [_packed(features(t, flags)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x, pa.binary())], names=["_id", "_y", "x"])

    kind = dict(docs.dtypes)[key]
    coded = chosen.select("_id", "_t", "_y").mapInArrow(lean(encode), f"_id {kind}, _y int, x binary").groupBy("_id", "_y").agg(F.min("x").alias("x")).withColumn("_o", F.xxhash64("_id"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for b in batches:
            got += zip(b.column(3).to_pylist(), b.column(0).to_pylist(), b.column(1).to_pylist(), (np.frombuffer(_unpacked(x), np.int32) for x in b.column(2).to_pylist()), strict=True)
        got.sort(key=lambda r: r[:2])
        ends = np.cumsum([len(r[3]) for r in got])
        got = [r[1:] for r, end in zip(got, ends, strict=True) if end <= fit_features]
        got.sort(key=lambda r: r[0])
        y = np.array([r[1] for r in got])
        if len(set(y.tolist())) < 2:
            m = {"constant": prior}
        else:
            m = fit([r[2] for r in got], y, prior)
        arrays = [m.pop(k).tobytes() if k in m else None for k in ("ratio", "w")]
        yield pa.RecordBatch.from_arrays([pa.array([arrays[0]], pa.binary()), pa.array([arrays[1]], pa.binary()), pa.array([json.dumps(m)], pa.string())], names=["ratio", "w", "rest"])

    row = coded.repartition(1).mapInArrow(lean(learn), "ratio binary, w binary, rest string").first()
    if row is None:
        return {"constant": prior}
    model = json.loads(row["rest"])
    if row["w"] is not None:
        model |= {"ratio": np.frombuffer(row["ratio"], np.float32), "w": np.frombuffer(row["w"], np.float32)}
    return model


def score(docs: DataFrame, model: dict, text: str = "text", out: str = "score") -> DataFrame:
    """All columns of ``docs`` and the probability of a good text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    docs = docs.drop(out) if out != text else docs
    at = docs.columns.index(text)
    names = [*docs.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(SIZE, bool)
        m = shared.value
        for b in batches:
            if "constant" in m:
                s = [float(m["constant"])] * b.num_rows
            else:
                s = [1 / (1 + float(np.exp(-np.clip(m["slope"] * margin(m, features(t, flags)) + m["shift"], -30, 30)))) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=names)

    schema = ", ".join(f"`{c}` {k}" for c, k in docs.dtypes)
    return docs.mapInArrow(lean(run), f"{schema}, `{out}` double")

"""Quality classifier: Naive Bayes support vectors.

n-gram indicators are scaled by the classes' log-count ratios, and a linear hinge-loss model is fit to them by dual
coordinate descent. The n-grams are one and two words, and two and three word shapes (letters, case, digits, marks and
whether a word repeats the one before), hashed. The margin is turned into a probability by a logistic curve that is fit
to labelled rows left out of the fit.

The model is fit on a bounded sample of the labelled rows: at most about SAMPLE_PER_CLASS rows of each class, chosen by a
hash of the id. Everything else covers all rows: every whole text is scored.

Defined results: null and empty texts have no n-grams and get the score of the model's bias; rows with a null label, or
with an id whose remainder is that of the held-out part, are never learned from; an id with several labels counts by their
mean; with labels of one class or none the score is that class's share (0.5 without any); repeated rows are scored alike;
an empty table gives an empty result; other columns are passed through, but that one of the output's name is replaced.
Where an id has several texts the one with the least hash is learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, free_name, hash_sample, tidy

SAMPLE_PER_CLASS = 1500
SPACE = 1 << 18  # hashed n-grams
EPOCHS = 6
C = 0.05
SMOOTH = 1.0
THRESHOLD = 0.7
_MEMO = 150_000
_M = np.uint64(0x9E3779B97F4A7C15)


def _shape(word: str) -> str:
    """Runs of: a lower, A upper, 0 digit, others as they are. Of the whole word."""
    out = []
    for ch in word:
        kind = "0" if ch.isdigit() else "A" if ch.isupper() else "a" if ch.isalpha() else ch
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out)


class _Words(dict):
    """word -> 64 bits: a hash of the lower-cased word above, of its shape below. Remembers short words; forgets all when full."""

    def __missing__(self, word: str) -> int:
        value = (xxhash.xxh32_intdigest(word.lower().encode("utf-8", "surrogatepass")) << 32) | xxhash.xxh32_intdigest(_shape(word).encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            if len(self) >= _MEMO:
                self.clear()
            self[word] = value
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def ngram_indicators(text: str, memo: _Words) -> np.ndarray:
    """Distinct hashed n-grams of a whole text, sorted."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64)
    both = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    w, s = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    same = np.zeros(len(w), np.uint64)
    same[1:] = w[1:] == w[:-1]
    s = s * np.uint64(2) + same
    parts = [_mixed(w * _M + np.uint64(1)), _mixed(s * _M + np.uint64(3))]
    if len(w) > 1:
        pair = s[:-1] * _M + s[1:]
        parts += [_mixed((w[:-1] * _M + w[1:]) * _M + np.uint64(2)), _mixed(pair * _M + np.uint64(4))]
        if len(w) > 2:
            parts.append(_mixed((pair[:-1] * _M + s[2:]) * _M + np.uint64(5)))
    return np.unique((np.concatenate(parts) >> np.uint64(64 - 18)).astype(np.int64))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """ln of the n-gram's smoothed share among indicators of class 1 over that of class 0; 0 for n-grams in fewer than 3 rows."""
    count = {c: np.full(SPACE, SMOOTH) for c in (1, -1)}
    for r, c in zip(rows, y.tolist(), strict=True):
        count[c][r] += 1
    p, q = count[1], count[-1]
    seen = p + q - 2 * SMOOTH
    n1, n0 = max(1, int((y == 1).sum())), max(1, int((y == -1).sum()))
    return np.where(seen >= 3, np.log((p / (n1 + 2 * SMOOTH)) / (q / (n0 + 2 * SMOOTH))), 0.0)


def dual_coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, c: float = C) -> tuple[np.ndarray, float]:
    """Weights and bias of the L1-loss linear support vector machine over scaled, length-normalised indicators."""
    values = []
    for r in rows:
        v = scale[r]
        values.append(v / max(1e-9, float(np.sqrt(v @ v + 1.0))))
    ones = np.array([1.0 / max(1e-9, float(np.sqrt(scale[r] @ scale[r] + 1.0))) for r in rows])
    norm = np.array([float(v @ v) for v in values]) + ones * ones
    w, b, alpha, order = np.zeros(SPACE), 0.0, np.zeros(len(rows)), np.random.default_rng(7)
    balance = {1: 1.0, -1: max(1.0, float((y == 1).sum()) / max(1.0, float((y == -1).sum())))}
    upper = np.array([c * 100 * balance[t] for t in y.tolist()])
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            r, v, t = rows[i], values[i], y[i]
            step = (t * (float(w[r] @ v) + b * ones[i]) - 1.0) / max(norm[i], 1e-12)
            new = min(max(alpha[i] - step, 0.0), upper[i])
            if new != alpha[i]:
                d = (new - alpha[i]) * t
                w[r] += d * v
                b += d * ones[i]
                alpha[i] = new
    return w, b


def margins(rows: list[np.ndarray], weight: np.ndarray, square: np.ndarray, b: float) -> np.ndarray:
    """weight: w times the ratios; square: the ratios' squares."""
    return np.array([(float(weight[r].sum()) + b) / float(np.sqrt(square[r].sum() + 1.0)) for r in rows])


def logistic_fit(m: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and offset of the probability of class 1 by margin, on rows weighted to the prior; Newton's method."""
    t = (y == 1).astype(float)
    n1, n0 = max(t.sum(), 1), max((1 - t).sum(), 1)
    weight = np.where(t == 1, prior / n1, (1 - prior) / n0) * len(t)
    t = np.where(t == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g, h = weight * (p - t), weight * p * (1 - p) + 1e-9
        gradient = np.array([(g * m).sum() + 1e-3 * a, g.sum()])
        hessian = np.array([[(h * m * m).sum() + 1e-3, (h * m).sum()], [(h * m).sum(), h.sum() + 1e-6]])
        delta = np.linalg.solve(hessian, gradient)
        a, b = a - delta[0], b - delta[1]
        if np.abs(delta).max() < 1e-7:
            break
    return float(max(a, 1e-3)), float(b)


def fit(rows: list[np.ndarray], labels: list[int], prior: float) -> dict:
    y = np.where(np.asarray(labels, dtype=int) > 0, 1, -1)
    if len(set(y.tolist())) < 2:
        share = 0.5 if not len(y) else float((y == 1).mean())
        offset = float(np.log(max(share, 0.01) / max(1 - share, 0.01)))
        return {"weight": np.zeros(SPACE, np.float32), "square": np.zeros(SPACE, np.float32), "b": 0.0, "slope": 1.0, "offset": offset}
    part = np.arange(len(rows)) % 4  # rows come in hash order
    if all(len(set(y[k].tolist())) == 2 for k in (part > 0, part == 0)):
        some, rest = [r for r, k in zip(rows, part, strict=True) if k], [r for r, k in zip(rows, part, strict=True) if not k]
        ratio = log_count_ratios(some, y[part > 0])
        w, b = dual_coordinate_descent(some, ratio, y[part > 0])
        slope, offset = logistic_fit(margins(rest, w * ratio, ratio * ratio, b), y[part == 0], prior)
    else:
        slope, offset = 4.0, 0.0
    ratio = log_count_ratios(rows, y)
    w, b = dual_coordinate_descent(rows, ratio, y)
    return {"weight": (w * ratio).astype(np.float32), "square": (ratio * ratio).astype(np.float32), "b": b, "slope": slope, "offset": offset}


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> dict:
    """labels: (doc_id, quality). Learns only from ids whose crc32 modulo 4 is not 2."""
    known = labels.filter(F.col("quality").isNotNull() & (crc_mod("doc_id", 4) != 2))
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    counts = {r.quality: r.n for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = hash_sample(known, "quality", ["doc_id"], per_class, 2)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # the sample's ids, so texts are not shuffled
    texts = texts.groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "t.text", "quality")  # one text an id

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Words()
        for batch in batches:
            grams = [ngram_indicators(x.as_py(), memo).astype(np.int32) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(grams, pa.list_(pa.int32()))], ["doc_id", "quality", "grams"])

    found = texts.mapInArrow(tidy(work), "doc_id bigint, quality int, grams array<int>").orderBy(F.xxhash64("doc_id"), "doc_id")
    table = found.toArrow()
    grams = [np.asarray(x.values.to_numpy(), np.int64) for x in table.column("grams")]
    n1 = counts.get(1, 0)
    return fit(grams, table.column("quality").to_pylist(), n1 / max(1, sum(counts.values())))


def score(docs: DataFrame, model: dict, text: str = "text", name: str = "score") -> DataFrame:
    """Adds the probability of good quality of each whole text; a column of that name is replaced."""
    docs = docs.drop(name)
    names, shared = docs.columns, docs.sparkSession.sparkContext.broadcast(model)  # two floats for each hashed n-gram: 2 MB

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, m = _Words(), shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for k, x in enumerate(batch.column(names.index(text))):
                grams = ngram_indicators(x.as_py() or "", memo)
                out[k] = (m["weight"][grams].sum(dtype=np.float64) + m["b"]) / np.sqrt(m["square"][grams].sum(dtype=np.float64) + 1.0)
            out = 1 / (1 + np.exp(-np.clip(m["slope"] * out + m["offset"], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*names, name])

    return docs.mapInArrow(tidy(work), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns for each document."""
    model = train(docs, labels)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents that the classifier does not reject, with their columns."""
    name = free_name("quality_score", docs.columns)
    return score(docs, train(docs, labels), name=name).filter(F.col(name) >= threshold).drop(name)

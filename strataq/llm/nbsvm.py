"""Quality classifier: a linear support vector machine on naive Bayes features.

Features are indicators of byte 4-grams and of 3-grams of word shapes, hashed.
Each is scaled by its class log-count ratio; the weights come from the squared
hinge loss by dual coordinate descent; a logistic curve fitted on rows kept apart
turns margins into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strataq.llm.batch import U, chunks, column, prefix_hash, span_hash, text_bytes, widened, word_spans
from strataq.llm.shared import bound_batches, frugal

BYTE_BITS, SHAPE_BITS = 17, 15
DIMS = (1 << BYTE_BITS) + (1 << SHAPE_BITS)


def _end_class() -> np.ndarray:
    out = np.full(256, 5, np.int64)  # any other byte
    out[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 0
    out[[*range(48, 58)]] = 1
    out[ord(".")] = 2
    out[ord(",")] = 3
    out[ord("!")] = 4
    return out


_END = _end_class()
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1


def feature_ids(data: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """For each document of a chunk, the numbers of its distinct features."""
    n = len(data)
    x = data.astype(U)
    quads = np.zeros(n, np.int64)
    if n >= 4:
        v = x[:-3] << U(24) | x[1:-2] << U(16) | x[2:-1] << U(8) | x[3:]
        quads[: n - 3] = ((v * U(0x9E3779B97F4A7C15)) >> U(64 - BYTE_BITS)).astype(np.int64)
    s, e, docs = word_spans(data, at)
    if len(s):
        upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
        caps = np.where(upper[e] - upper[s] > 1, 2, _UPPER[data[s]])
        length = np.minimum(np.log2(e - s).astype(np.int64), 4)
        h = span_hash(prefix_hash(data), s, e)
        same = np.zeros(len(s), np.int64)
        same[1:] = h[1:] == h[:-1]
        same[docs[:-1][docs[:-1] < len(s)]] = 0
        shape = (((caps * 6 + _END[data[e - 1]]) * 5 + length) * 2 + same + 1).astype(U)
        tri = shape.copy()
        tri[1:] += shape[:-1] << U(10)
        tri[2:] += shape[:-2] << U(20)
        first = docs[:-1][docs[:-1] < len(s)]
        tri[first] = shape[first]
        second = (docs[:-1] + 1)[docs[:-1] + 1 < docs[1:]]
        tri[second] = shape[second] + (shape[second - 1] << U(10))
        tri = (1 << BYTE_BITS) + ((tri * U(0xC2B2AE3D27D4EB4F)) >> U(64 - SHAPE_BITS)).astype(np.int64)
    else:
        tri = np.zeros(0, np.int64)
    seen = np.zeros(DIMS, np.int32)
    for d in range(len(at) - 1):
        ids = np.concatenate([quads[at[d] : max(at[d], at[d + 1] - 3)], tri[docs[d] : docs[d + 1]]])
        order = np.arange(1, len(ids) + 1, dtype=np.int32)
        seen[ids] = order
        yield ids[seen[ids] == order]


class Model:
    """weights (already times the log-count ratios), ratios, and the logistic curve."""

    def __init__(self, weight: np.ndarray, ratio: np.ndarray, slope: float, shift: float):
        self.weight, self.square, self.slope, self.shift = weight.astype(np.float32), (ratio * ratio).astype(np.float32), slope, shift

    def margin(self, ids: np.ndarray) -> float:
        norm = float(np.sqrt(self.square[ids].sum())) if len(ids) else 0.0
        return float(self.weight[ids].sum()) / norm if norm > 0 else 0.0

    def score(self, ids: np.ndarray) -> float:
        z = self.slope * self.margin(ids) + self.shift
        return float(1.0 / (1.0 + np.exp(-max(-500.0, min(500.0, z)))))


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int, seed: int = 7) -> np.ndarray:
    """Squared-hinge SVM: min |w|^2/2 + sum cost_i max(0, 1 - y_i w.x_i)^2, one dual variable at a time."""
    w, alpha = np.zeros(DIMS + 1), np.zeros(len(rows))
    diag = 0.5 / cost
    norm = np.array([v @ v + 1.0 for v in values]) + diag
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            g = y[i] * (w[rows[i]] @ values[i] + w[DIMS]) - 1.0 + diag[i] * alpha[i]
            if alpha[i] == 0.0 and g >= 0.0:
                continue
            new = max(alpha[i] - g / norm[i], 0.0)
            step = (new - alpha[i]) * y[i]
            alpha[i] = new
            w[rows[i]] += step * values[i]
            w[DIMS] += step
    return w


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method, with smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    b = np.array([0.0, np.log((pos + 1) / (neg + 1))])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2)
        b = b - np.linalg.solve(h, x.T @ (p - t))
    return float(b[0]), float(b[1])


def fit(rows: list[np.ndarray], quality: np.ndarray, smooth: float = 1.0, cost: float = 4.0, epochs: int = 12) -> Model:
    """Fits the model; a fifth of the rows is kept for the logistic curve.  With one class only, scores are constant."""
    y = np.where(quality > 0, 1.0, -1.0)
    if not len(rows) or (y > 0).all() or (y < 0).all():
        return Model(np.zeros(DIMS), np.zeros(DIMS), 0.0, 0.0 if not len(rows) else 8.0 * float(y[0]))
    apart = np.arange(len(rows)) % 5 == 4
    fit_on = np.flatnonzero(~apart)
    if len(set(y[fit_on])) < 2 or len(set(y[apart])) < 2:
        apart, fit_on = np.ones(len(rows), bool), np.arange(len(rows))
    counts = {s: np.bincount(np.concatenate([rows[i] for i in fit_on if y[i] == s]), minlength=DIMS) + smooth for s in (1.0, -1.0)}
    ratio = np.log(counts[1.0] / (y[fit_on] > 0).sum()) - np.log(counts[-1.0] / (y[fit_on] < 0).sum())
    ratio[(counts[1.0] + counts[-1.0]) <= 2 * smooth] = 0.0
    values = []
    for i in fit_on:
        v = ratio[rows[i]]
        norm = np.sqrt(v @ v)
        values.append(v / norm if norm > 0 else v)
    balance = np.where(y[fit_on] > 0, len(fit_on) / (2 * (y[fit_on] > 0).sum()), len(fit_on) / (2 * (y[fit_on] < 0).sum()))
    w = dual_descent([rows[i] for i in fit_on], values, y[fit_on], cost * balance, epochs)
    model = Model(w[:DIMS] * ratio, ratio, 1.0, 0.0)
    held = np.flatnonzero(apart)
    model.slope, model.shift = logistic(np.array([model.margin(rows[i]) for i in held]), y[held])
    return model


def labelled_features(df: DataFrame, labels: DataFrame, most_rows: int, key_column: str, text: str, label: str) -> tuple[list[np.ndarray], np.ndarray]:
    """Features of about ``most_rows`` labelled documents, chosen by a hash of the key."""
    labels = labels.filter(F.col(label).isNotNull() & F.col(key_column).isNotNull()).select(key_column, F.col(label).cast("int").alias("_label"))
    n = labels.count()
    chance = F.pmod(F.xxhash64(F.col(key_column), F.lit("nbsvm")), F.lit(1 << 40)) / float(1 << 40)
    chosen = labels.filter(chance < min(1.0, most_rows / max(1, n))).groupBy(key_column).agg(F.max("_label").alias("_label"))
    found = df.select(key_column, text).join(F.broadcast(chosen), key_column).select(key_column, text, "_label")

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            data, at = text_bytes(column(b, text))
            for i, j in chunks(at):
                out += [ids.astype("<u4").tobytes() for ids in feature_ids(data[at[i] : at[j]], at[i : j + 1] - at[i])]
            yield pa.RecordBatch.from_arrays([column(b, key_column).cast(pa.string()), column(b, "_label"), pa.array(out, pa.binary())], ["k", "y", "ids"])

    rows = sorted(found.mapInArrow(run, "k string, y int, ids binary").collect(), key=lambda r: r["k"])
    return [np.frombuffer(r["ids"], "<u4").astype(np.int64) for r in rows], np.array([r["y"] for r in rows])


def quality_scores(df: DataFrame, train: DataFrame, labels: DataFrame, most_rows: int = 5000, key_column: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Adds ``score`` (0 to 1, higher: label 1 likelier) to every row of ``df``.

    The model is fitted on about ``most_rows`` rows of ``train`` that ``labels``
    names, of any length.  A null text counts as empty and gets the
    score of a text without features.  A column named ``score`` is replaced.
    """
    bound_batches(df.sparkSession)
    rows, y = labelled_features(train, labels, most_rows, key_column, text, label)
    model = df.sparkSession.sparkContext.broadcast(fit(rows, y))
    df = df.drop("score")

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            out: list[float] = []
            data, at = text_bytes(column(b, text))
            for i, j in chunks(at):
                out += [m.score(ids) for ids in feature_ids(data[at[i] : at[j]], at[i : j + 1] - at[i])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], [*b.schema.names, "score"])

    return df.mapInArrow(run, widened(df, score="double"))

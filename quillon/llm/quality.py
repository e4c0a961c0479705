"""Quality classifier: Naive Bayes support vectors.

Indicators of token-form n-grams are scaled by the log ratio of their smoothed class counts (over all labelled training rows), and a linear hinge-loss model is
fitted to them by dual coordinate descent on at most ``SAMPLED`` rows of each class. The weights are averaged with their mean size, as usual for this model, and a logistic
curve fitted on every fifth row, which the model has not seen, turns margins into probabilities under the classes' shares of all labelled rows.

Defined cases: a null text counts as empty and has a feature of its own; every row gets a score, rows that repeat a doc_id each their own; rows with a null doc_id
are scored and never learned from (their held_out is false unless crc32 of an empty text says so); without a label of 0 every score is 1, with labels of 0
only every score is 0; an empty table gives an empty result; other columns are ignored (``scored``) or carried (``keep_good``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import documents, forgetful, id_crc32, labels
from quillon.llm.learned import FEATURES, SAMPLED, class_counts, forget, labelled, sample, shape_features

THRESHOLD = 0.7


@dataclass
class Model:
    weight: np.ndarray  # of each feature, its log ratio included
    bias: float
    slope: float
    shift: float

    def score(self, f: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * (self.weight[f].sum() + self.bias) + self.shift, -40, 40))))


def dual_descent(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = 20, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias of L2-regularised hinge loss. Row i has values[j] at each j of rows[i] and a constant 1; y is -1 or 1."""
    w, bias, alpha = np.zeros(len(values)), 0.0, np.zeros(len(rows))
    norm = np.array([values[f] @ values[f] + 1 for f in rows])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            f = rows[i]
            v = values[f]
            g = y[i] * (w[f] @ v + bias) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
            if (d := (new - alpha[i]) * y[i]) != 0:
                w[f] += d * v
                bias += d
                alpha[i] = new
                moved = max(moved, abs(d))
        if moved < 1e-4:
            break
    return w, bias


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that fit y (0 or 1) by Newton steps, with softened targets."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    x = np.stack([margin, np.ones_like(margin)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        grad = x @ (p - t) + 1e-3 * np.array([a - 1, b])
        hess = (x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def fit(docs: DataFrame, label_rows: DataFrame, smooth: float = 1.0, cost: float = 0.1, blend: float = 0.25, each: int = SAMPLED) -> Model:
    rows = labelled(docs, label_rows, "quality", shape_features)
    table, n = class_counts(rows)
    if not n[0] or not n[1]:
        return Model(np.zeros(FEATURES), 0.0, 0.0, -40.0 if n[0] else 40.0)
    ratio = np.log((table[1] + smooth) / (n[1] + 2 * smooth)) - np.log((table[0] + smooth) / (n[0] + 2 * smooth))
    f, _, y = sample(rows, n, each)
    sign = 2 * y - 1
    check = np.arange(len(f)) % 5 == 4
    if min((check & (y == 0)).sum(), (check & (y == 1)).sum()) < 5:
        check[:] = True  # too few rows to set some aside
        learn = check
    else:
        learn = ~check
    share = np.array([max(1, (y[learn] == c).sum()) for c in (0, 1)])
    use = np.flatnonzero(learn)
    w, bias = dual_descent([f[i] for i in use], ratio, sign[use], cost * len(use) / (2 * share[y[use]]))
    used = np.abs(w[w != 0])
    w = (1 - blend) * (used.mean() if len(used) else 0) + blend * w
    weight, bias = w * ratio, blend * bias
    at = np.flatnonzero(check)
    margin = np.array([weight[f[i]].sum() + bias for i in at])
    scale = np.abs(margin).mean() or 1.0
    slope, shift = _logistic(margin / scale, y[at])
    prior = np.log(n[1] / n[0]) - np.log((y[at] == 1).sum() / max(1, (y[at] == 0).sum()))
    return Model(weight.astype(np.float64), float(bias), slope / scale, shift + float(prior))


def _with_score(docs: DataFrame, model: Model, at: int, schema, keep=None) -> DataFrame:
    """docs through the model as a column ``q_score`` (or, with ``keep``, only rows of at least that score and no column)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            s = np.array([m.score(shape_features(x)) for i in range(0, b.num_rows, 500) for x in b.column(at).slice(i, 500).to_pylist()], np.float64)
            if keep is None:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], names=[*b.schema.names, "q_score"])
            else:
                yield b.filter(pa.array(s >= keep))

    return docs.mapInArrow(forgetful(run, forget), schema)


def scored(docs: DataFrame, label_rows: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = _with_score(rows, model or fit(docs, label_rows), 1, "doc_id long, text string, q_score double")
    return out.select("doc_id", (id_crc32(F.col("doc_id")) % 4 == 2).alias("held_out"), F.col("q_score").alias("score"), (F.col("q_score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, label_rows: DataFrame, threshold: float = THRESHOLD, model: Model | None = None) -> DataFrame:
    """docs' rows, whole, that score at least the threshold. Nothing is shuffled but the labelled rows' features."""
    return _with_score(docs, model or fit(docs, label_rows), docs.columns.index("text"), docs.schema, threshold)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir), labels(spark, sf_dir))


SQL: dict[str, str] = {}
QUERIES = {"op7_quality": op7_quality}

"""Quality classifier by positive-unlabelled learning.

Only trusted positives (rows that are marked 1 and never 0) and unlabelled text enter the fit; negative marks are not
used at all. With class prior p, the risk is p R+(positives) + max(0, R-(unlabelled) - p R-(positives)): the unbiased
estimate of the risk with negatives, kept from going below zero (when it would, the step goes the other way). The loss
is logistic, so the model's sigmoid estimates the probability of label 1.

The prior is estimated from positives and unlabelled text alone: a model that tells the two apart ranks the texts; in the
top of the ranking nearly all are positives, so the share of all texts there over the share of the positives there is an
upper bound of the prior, and the least of these bounds (less two standard errors of either share) is the estimate.

Inputs are numbers on how the whole text is written (``style``) and the shares of its words by hash (LEXICAL buckets);
labels, language, source and id are none. They are written once as a table; then every round of either fit is a sum of
gradients and curvatures over all unlabelled rows of it, added up in Spark by rows of the matrix, and one Newton step.
Positives: POSITIVES ids at most (lowest hash), each of their texts once. All texts are scored in one map.

Defined results: null and empty texts are scored like any other (by the mark for emptiness); repeated rows each get
their score and count as often among the unlabelled; an id with both labels is no positive, a null label is none; a null
id is scored, held out from learning, and not marked as held out; a score of exactly the threshold is predicted 1;
without positives or unlabelled rows every score is the prior of 0.5; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import crc_mod, lower_ascii, sliced, staged, words
from tallymark.llm.style import N_PLAIN, expand, style

POSITIVES, THRESHOLD, LEXICAL, ROUNDS, DECAY, BINS = 10_000, 0.3, 64, 8, 3e-3, 1000
_BUCKETS: dict[str, int] = {}  # a worker's memory


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def lexical(text: str | None) -> list[float]:
    """The share of the text's words in each of LEXICAL buckets by hash, case and marks at the end left out."""
    known, out = _BUCKETS, [0.0] * LEXICAL
    if len(known) > 100_000:
        known.clear()
    ws = words(text or "")
    for w in ws:
        b = known.get(w)
        if b is None:
            b = known[w] = xxhash.xxh32_intdigest(lower_ascii(w).rstrip(".,;:!?").encode("utf-8", "replace")) % LEXICAL
        out[b] += 1
    return [x / len(ws) for x in out] if ws else out


WIDTH = 3 * N_PLAIN + LEXICAL


def inputs(df: DataFrame, carried: str) -> DataFrame:
    """The ``carried`` columns (as a schema) with ``x``, the plain numbers of each text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            x = [style(t) + lexical(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            rest = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in rest], pa.array(x, pa.list_(pa.float32()))], [*rest, "x"])

    return df.mapInArrow(rows, f"{carried}, x array<float>")


def matrix(plain: np.ndarray) -> np.ndarray:
    """Rows of plain numbers as inputs of a linear model (before they are centred)."""
    plain = np.asarray(plain, dtype=np.float64).reshape(-1, N_PLAIN + LEXICAL)
    return np.c_[expand(plain[:, :N_PLAIN]), plain[:, N_PLAIN:]]


class Scale(NamedTuple):
    mean: np.ndarray
    spread: np.ndarray

    def of(self, plain: np.ndarray) -> np.ndarray:
        """Centred inputs and a last column of ones."""
        z = np.clip((matrix(plain) - self.mean) / self.spread, -8, 8)
        return np.c_[z, np.ones(len(z))]


def add_up(table: DataFrame, parts) -> np.ndarray:
    """The sum over all rows of table (x) of ``parts(plain)``, a matrix that adds up over rows: tasks send it a row each,
    Spark sums rows alike, and only the sum comes to the driver."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in sliced(batches, 4096):
            one = parts(batch.column(0).flatten().to_numpy(zero_copy_only=False))
            total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array([r.tobytes() for r in total], pa.binary())], ["row", "sums"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": pdf["row"][:1], "sums": [sum(np.frombuffer(s) for s in pdf["sums"]).tobytes()]})

    out = table.select("x").mapInArrow(rows, "row bigint, sums binary").groupBy("row").applyInPandas(add, "row bigint, sums binary").toPandas().sort_values("row")
    return np.stack([np.frombuffer(s) for s in out["sums"]])


def _curve(scale: Scale, w: np.ndarray):
    """Of rows as plain numbers: their number, losses and gradient if all were negative, and the curvature."""

    def parts(plain: np.ndarray) -> np.ndarray:
        x = scale.of(plain)
        z = x @ w
        p = _sigmoid(z)
        head = np.zeros((2, len(w)))
        head[0, :2] = len(x), np.logaddexp(0, z).sum()
        head[1] = p @ x
        return np.concatenate([head, (x * (p * (1 - p))[:, None]).T @ x])

    return parts


def _solve(curvature: np.ndarray, gradient: np.ndarray, most: float = 6.0) -> np.ndarray:
    """The Newton step, shortened where it is long."""
    step = np.linalg.solve(curvature, gradient)
    return step * min(1.0, most / (np.linalg.norm(step) + 1e-12))


def _decay(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.full(len(w), DECAY)
    d[-1] = 1e-6
    return d * w, np.diag(d)


def fit_apart(positive: DataFrame, unlabelled: DataFrame, scale: Scale, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of the logistic model that tells positives from unlabelled rows, both sides weighing the same."""
    w, total = np.zeros(len(scale.mean) + 1), add_up(positive, lambda plain: scale.of(plain).sum(axis=0)[None])[0]
    for _ in range(rounds):
        u, p = (add_up(t, _curve(scale, w)) for t in (unlabelled, positive))
        pull, ridge = _decay(w)
        gradient = (u[1] / u[0, 0] + (p[1] - total) / p[0, 0]) / 2 + pull
        w = w - _solve((u[2:] / u[0, 0] + p[2:] / p[0, 0]) / 2 + ridge, gradient)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """positive, unlabelled: how many rows of each have a score in each bin, by rising score."""
    n_p, n_u = positive.sum(), unlabelled.sum()
    p, u = (np.cumsum(c[::-1]) / c.sum() for c in (positive, unlabelled))
    some = p > 0.05
    error = lambda x, n: 2 * np.sqrt(np.maximum(x * (1 - x), 1 / n) / n)
    bound = (u + error(u, n_u))[some] / np.maximum(p - error(p, n_p), 1e-9)[some]
    return float(np.clip(bound.min(), 0.01, 0.99))


def fit_pu(positive: DataFrame, unlabelled: DataFrame, prior: float, scale: Scale, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (the last is the constant) of the least non-negative risk."""
    w, total = np.zeros(len(scale.mean) + 1), add_up(positive, lambda plain: scale.of(plain).sum(axis=0)[None])[0]
    for _ in range(rounds):
        u, p = (add_up(t, _curve(scale, w)) for t in (unlabelled, positive))
        pull, ridge = _decay(w)
        n = p[0, 0]
        negative = u[0, 1] / u[0, 0] - prior * p[0, 1] / n
        curvature = u[2:] / u[0, 0] + ridge
        if negative >= 0:
            w = w - _solve(curvature, u[1] / u[0, 0] - prior * total / n + pull)
        else:  # the other way, on the negative part alone
            w = w + _solve(curvature, u[1] / u[0, 0] - prior * p[1] / n, 0.5)
    return w


class Model(NamedTuple):
    scale: Scale
    weights: np.ndarray
    prior: float


def train(docs: DataFrame, labels: DataFrame, mark: str = "quality", folds: int = 5) -> Model:
    """docs: doc_id, text."""
    marks = labels.where((crc_mod("doc_id", folds) != 0) & F.col(mark).isNotNull()).groupBy("doc_id").agg(F.min(mark).alias("least"), F.max(mark).alias("most"))
    trusted = marks.where("least = 1 and most = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(POSITIVES).select("doc_id")
    table = docs.where(crc_mod("doc_id", folds) != 0).select("doc_id", F.xxhash64("text").alias("th"), "text")
    table = staged(inputs(table, "doc_id bigint, th bigint"), "quality-inputs")
    positive = staged(table.join(F.broadcast(trusted), "doc_id").dropDuplicates(["doc_id", "th"]).select("x"), "quality-positives")  # POSITIVES ids
    none = Model(Scale(np.zeros(WIDTH), np.ones(WIDTH)), np.zeros(WIDTH + 1), 0.5)
    if positive.isEmpty():
        return none

    def moments(plain: np.ndarray) -> np.ndarray:
        x = matrix(plain)
        return np.stack([np.full(x.shape[1], len(x)), x.sum(axis=0), (x * x).sum(axis=0)])

    n, total, squares = add_up(table, moments)
    mean = total / n
    scale = Scale(mean, np.sqrt(np.maximum(squares / n - mean * mean, 0)) + 1e-6)
    w = fit_apart(positive, table, scale)
    bins = lambda plain: np.bincount(np.minimum((_sigmoid(scale.of(plain) @ w) * BINS).astype(int), BINS - 1), minlength=BINS).astype(float)[None]
    prior = estimate_prior(add_up(positive, bins)[0], add_up(table, bins)[0])
    return Model(scale, fit_pu(positive, table, prior, scale), prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            x = model.scale.of(np.array([style(t) + lexical(t) for t in batch.column(1).to_pylist()], dtype=np.float32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_sigmoid(x @ model.weights))], ["doc_id", "score"])

    return docs.mapInArrow(rows, "doc_id bigint, score double")


def digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    scored = score(docs, train(docs, labels))
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

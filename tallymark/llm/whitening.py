"""Whitening of embeddings by a covariance that is merged from partitions.

1. Entries become integers, x = floor(scale * c); the fit list holds each distinct vector of them once and is stored.
2. Each task goes through its part in batches: count, mean and scatter about that mean; batches and then partitions
   are merged pairwise by Chan's formula, partitions in ``treeReduce``. The integer sums go along, exactly.
3. The driver takes the eigenvectors (``eigh``) of the one matrix that arrives there, of the vectors' width.
4. A second pass over the fit list whitens it and merges the covariance of the result in the same way: its largest
   distance from the identity is part of every row.
5. One narrow map whitens all rows.

What is moved, besides the distinct vectors once, is a matrix a task. A vector that a third of all rows hold is merged
in the tasks before the shuffle. A row's squared deviation is exact: in 64-bit integers where a bound of the batch proves
that they hold it, in Python's otherwise.

Defined results: null vectors and those holding null or non-finite entries are left out, as are those whose
length is not the commonest one of the fit list (of equally common ones the shortest counts), empty ones included. Entries
beyond 64-bit integers are cut to these. A component whose variance is no more than rounding error has no
whitened value (null) and takes no part in the check; with all vectors equal there is no explained share either. A deviation
beyond 64-bit integers is null. Repeated rows and rows without an id are rows of the result; vectors with fewer entries
than components asked for have as many components as entries. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import sliced, staged

#: Rows of a batch in a task.
ROWS = 4096
_LIMIT = 1 << 62


class Moments(NamedTuple):
    """Count, exact sums (Python integers), mean and scatter about the mean of some vectors."""

    n: int
    sums: list[int]
    mean: np.ndarray
    scatter: np.ndarray


def moments(x: np.ndarray, whole: bool = True) -> Moments:
    """Of the rows of x; integer ones (``whole``) have exact sums, others none."""
    y = x.astype(np.float64)
    mean = y.mean(axis=0)
    y -= mean
    sums = [(int(hi) << 32) + int(lo) for hi, lo in zip((x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0), strict=True)] if whole else []
    return Moments(len(x), sums, mean, y.T @ y)


def merge(a: Moments, b: Moments) -> Moments:
    """Chan's pairwise formula; where sums are exact, so is the difference of the means before it is rounded."""
    n, delta = a.n + b.n, b.mean - a.mean
    if a.sums:
        delta = np.array([(a.n * q - b.n * p) / (a.n * b.n) for p, q in zip(a.sums, b.sums, strict=True)])
    return Moments(n, [p + q for p, q in zip(a.sums, b.sums, strict=True)], a.mean + delta * (b.n / n), a.scatter + b.scatter + np.outer(delta, delta) * (a.n * b.n / n))


def _matrix(column: pa.ListArray) -> np.ndarray:
    """The lists of a column without nulls, all of one length, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def merged(fit: DataFrame, of=moments) -> Moments:
    """The moments of all vectors in ``fit`` (one column, lists of one length, at least one row)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (of(_matrix(b.column(0))) for b in sliced(batches, ROWS) if len(b))
        if (m := reduce(lambda a, b: b if a is None else merge(a, b), each, None)) is not None:
            sums = pa.array([[str(s) for s in m.sums]], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([m.n]), sums, pa.array([m.mean]), pa.array([m.scatter.ravel()])], ["n", "sums", "mean", "scatter"])

    parts = fit.mapInArrow(part, "n bigint, sums array<string>, mean array<double>, scatter array<double>").rdd
    return parts.map(lambda r: Moments(r[0], [int(s) for s in r[1]], np.array(r[2]), np.array(r[3]).reshape(len(r[2]), -1))).treeReduce(merge)


class Whitening(NamedTuple):
    """What whitens a vector: count and sums of the fit list, components as columns, their variances and their shares."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    variances: np.ndarray
    explained: list[float | None]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: 64-bit integers where they surely hold it, Python's otherwise."""
        most = self.n * (int(np.abs(x.astype(np.float64)).max(initial=0)) + 1) + max((abs(s) for s in self.sums), default=0)
        return self.n * (x if most < _LIMIT else x.astype(object)) - np.array(self.sums, dtype=np.int64 if most < _LIMIT else object)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """NaN where a component has no variance."""
        y = (self.centred(x) / self.n).astype(np.float64) @ self.vectors
        return np.divide(y, np.sqrt(self.variances), out=np.full_like(y, np.nan), where=self.variances > 0)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum of squares of n * x - S of each row; None where 64-bit integers don't hold it."""
        d = self.centred(x)
        if d.dtype != object and x.shape[1] * float(np.abs(d).max(initial=0)) ** 2 < _LIMIT:
            return (d * d).sum(axis=1).tolist()
        exact = [sum(int(e) ** 2 for e in row) for row in d]
        return [e if e < 1 << 63 else None for e in exact]


def learn(m: Moments, components: int) -> Whitening:
    """Unit eigenvectors of the covariance (divisor n) by falling variance; the largest entry of each is positive."""
    variances, vectors = np.linalg.eigh(m.scatter / m.n)
    variances, vectors = variances[::-1], vectors[:, ::-1]
    total = float(np.trace(m.scatter)) / m.n
    some = np.where(variances > len(variances) * np.finfo(float).eps * max(variances[0], 0.0), variances, 0.0)[:components]
    vectors = vectors[:, :components]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return Whitening(m.n, m.sums, vectors * signs, some, [float(v) / total if total > 0 else None for v in some])


def quantised(df: DataFrame, scale: int, id_column: str, vector: str) -> DataFrame:
    """(vec_id, x): the rows whose vector is whole and finite, as integers."""
    v = F.col(f"`{vector}`")
    whole = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    x = F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("bigint"))
    return df.where(v.isNotNull() & whole).select(F.col(f"`{id_column}`").cast("bigint").alias("vec_id"), x.alias("x"))


def whiten(df: DataFrame, components: int = 4, scale: int = 256, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each row and component."""
    rows = quantised(df, scale, id_column, vector)
    fit = staged(rows.select("x").distinct(), "whitening-fit")
    lengths = fit.groupBy(F.size("x").alias("d")).count().where("d > 0").orderBy(F.desc("count"), "d").first()
    width = lengths[0] if lengths else 0
    fit = fit.where(F.size("x") == width)
    if not width:
        return rows.where("false").selectExpr("vec_id", "1 AS component", "0L AS n", "0L AS deviation", "0D AS whitened", "0D AS explained", "0D AS identity_error")
    w = learn(merged(fit), components)
    real = w.variances > 0

    def white(x: np.ndarray) -> Moments:
        return moments(w.whiten(x)[:, real], whole=False)

    error = None
    if real.any():
        check = merged(fit, white)
        error = float(np.abs(check.scatter / check.n - np.eye(int(real.sum()))).max())
    k = len(w.variances)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, ROWS):
            if not len(b):
                continue
            x = _matrix(b.column(1))
            y, n = w.whiten(x).ravel(), len(b)
            at = pa.array(np.repeat(np.arange(n), k))
            columns = [
                b.column(0).take(at),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                pa.array(np.full(n * k, w.n)),
                pa.array(w.deviation(x), pa.int64()).take(at),
                pa.array(y, mask=np.isnan(y)),
                pa.array(w.explained * n, pa.float64()),
                pa.array([error] * (n * k), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.where(F.size("x") == width).mapInArrow(out, "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")


def digest(df: DataFrame) -> DataFrame:
    return whiten(df)

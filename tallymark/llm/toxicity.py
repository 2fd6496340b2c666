"""Toxicity by a classifier chain.

The categories are predicted one after the other by linear models; each model sees the text's features and the
probabilities of the categories before it. In training these probabilities are out of fold (each row's come from
models that have not seen it), so that a later model meets the same errors as in use.

Features: the presence of words and word beginnings, hashed, of which the most telling are kept for each category (by
likelihood ratio), and, for low quality, numbers on how the whole text is written (``style``). The labels hold two marks, so the
chain runs: low quality, toxic, both. A text is toxic if its probability of "toxic" is at least ``THRESHOLD``.

The table of labels has one mark of toxicity, so the chain can hold no more kinds of it. The fit runs on at most ``ROWS`` labelled rows (lowest hash of the id, then of the text where ids have several; exact
copies once), all texts are scored in one
map, whole, without a shuffle.

Defined results: null and empty texts have no words and are scored by their emptiness; repeated rows each get their
score; an id with several labels is toxic if any says so and of low quality if any says so; a row of labels with a null
mark is none; a null id is scored and not marked as held out; a probability of exactly the threshold is toxic; without
labels every probability is 0.5 but those of toxic texts, 0, so nothing is toxic; an empty table gives none. Texts are
read whole, a slice of the table at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import crc_mod, lower_ascii, sliced, words
from tallymark.llm.quality import _sigmoid
from tallymark.llm.style import N_PLAIN, expand, style

ROWS, FOLDS, KEPT, SPACE, THRESHOLD = 6_000, 5, 256, 1 << 18, 0.5
CATEGORIES = ("low_quality", "toxic", "toxic_low_quality")
#: Categories that the way of writing tells. What is said makes a text toxic: there its style would only mislead where
#: it is unlike any text that was learned from.
STYLED = (True, False, False)
_EDGES = ".,;:!?*#$%&|\"'()[]"


def word_features(word: str) -> tuple[int, ...]:
    """Hash buckets of a word, without marks at its ends and case, and of its beginnings."""
    w = lower_ascii(word).strip(_EDGES)
    if not w:
        return ()
    return tuple(xxhash.xxh32_intdigest(f"{kind}{part}".encode("utf-8", "replace")) % SPACE for kind, part in (("w", w), ("4", w[:4]), ("5", w[:5])) if kind == "w" or len(w) >= int(kind))


class Model(NamedTuple):
    mean: np.ndarray
    spread: np.ndarray
    kept: list[dict[int, int]]  # for each category, its hash buckets by column
    weights: list[np.ndarray]


class _Part(NamedTuple):
    """Rows for one category: dense columns and, for each row, the columns of its kept features."""

    dense: np.ndarray
    rows: np.ndarray
    columns: np.ndarray

    def dot(self, w: np.ndarray) -> np.ndarray:
        d = self.dense.shape[1]
        return self.dense @ w[:d] + np.bincount(self.rows, w[d:][self.columns], minlength=len(self.dense))

    def back(self, r: np.ndarray, width: int) -> np.ndarray:
        return np.r_[self.dense.T @ r, np.bincount(self.columns, r[self.rows], minlength=width - self.dense.shape[1])]

    def take(self, some: np.ndarray) -> _Part:
        place = np.full(len(self.dense), -1)
        place[some] = np.arange(len(some))
        keep = place[self.rows] >= 0
        return _Part(self.dense[some], place[self.rows[keep]], self.columns[keep])


def _fit(part: _Part, y: np.ndarray, sparse: int, rounds: int = 150, rate: float = 0.1, decay: float = 3e-4) -> np.ndarray:
    width = part.dense.shape[1] + sparse
    w, m, v = np.zeros(width), 0.0, 0.0
    for i in range(1, rounds + 1):
        g = part.back(_sigmoid(part.dot(w)) - y, width) / max(1, len(y)) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return w


def _telling(rows: np.ndarray, buckets: np.ndarray, y: np.ndarray) -> dict[int, int]:
    """The KEPT buckets whose presence says most about y, by the likelihood-ratio statistic."""
    n, pos = len(y), y.sum()
    seen = np.bincount(buckets, minlength=SPACE).astype(float)
    with_pos = np.bincount(buckets[y[rows] > 0], minlength=SPACE).astype(float)
    some = np.flatnonzero((seen >= 5) & (seen <= n - 5))
    a, b = with_pos[some], seen[some] - with_pos[some]
    total = np.zeros(len(some))
    for x, out_of, share in ((a, seen[some], pos / n), (b, seen[some], 1 - pos / n), (pos - a, n - seen[some], pos / n), (n - pos - b, n - seen[some], 1 - pos / n)):
        total += 2 * x * np.log(np.maximum(x, 1e-9) / np.maximum(out_of * share, 1e-9))
    best = some[np.lexsort((some, -total))[:KEPT]]
    return {int(b): i for i, b in enumerate(best)}


def fit_chain(plain: np.ndarray, buckets: np.ndarray, sizes: np.ndarray, marks: dict[str, np.ndarray], fold: np.ndarray) -> Model:
    """plain: style numbers; buckets: those of all rows, one row after the other, sizes of them a row; marks: 0/1 for each category in order; fold: 0..FOLDS-1."""
    x = expand(plain)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    styled, earlier = np.clip((x - mean) / spread, -8, 8), np.ones((len(x), 1))
    rows = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    kept, weights = [], []
    for y, with_style in zip(marks.values(), STYLED, strict=True):
        dense = np.c_[earlier, styled] if with_style else earlier
        mine = _telling(rows, buckets, y)
        column = np.full(SPACE, -1, dtype=np.int32)
        column[list(mine)] = list(mine.values())
        use = column[buckets] >= 0
        part = _Part(dense, rows[use], column[buckets[use]])
        apart = np.full(len(y), 0.5)
        for f in range(FOLDS):
            out = np.flatnonzero(fold == f)
            if len(out) and len(out) < len(y):
                within = np.flatnonzero(fold != f)
                apart[out] = _sigmoid(part.take(out).dot(_fit(part.take(within), y[within], KEPT)))
        kept.append(mine)
        weights.append(_fit(part, y, KEPT))
        earlier = np.c_[earlier, apart]
    return Model(mean, spread, kept, weights)


def predict(model: Model, plain: np.ndarray, present: list[list[list[int]]]) -> np.ndarray:
    """A row for each text, a column for each category. present: each text's kept columns, by category."""
    styled = np.clip((expand(plain) - model.mean) / model.spread, -8, 8)
    earlier, out = np.ones((len(styled), 1)), []
    for c, w in enumerate(model.weights):
        dense = np.c_[earlier, styled] if STYLED[c] else earlier
        d = dense.shape[1]
        z = dense @ w[:d] + np.array([w[d:][p[c]].sum() if p[c] else 0.0 for p in present])
        out.append(_sigmoid(z))
        earlier = np.c_[earlier, out[-1]]
    return np.stack(out, axis=1)


def finder(model: Model) -> Callable[[str], list[list[int]]]:
    """Text -> its kept columns by category; remembers words."""
    known: dict[str, tuple[tuple[int, int], ...]] = {}

    def find(text: str) -> list[list[int]]:
        if len(known) > 200_000:
            known.clear()
        found: list[set[int]] = [set() for _ in model.kept]
        for w in set(words(text)):
            hits = known.get(w)
            if hits is None:
                hits = known[w] = tuple((c, k[b]) for b in word_features(w) for c, k in enumerate(model.kept) if b in k)
            for c, column in hits:
                found[c].add(column)
        return [sorted(f) for f in found]

    return find


def train(docs: DataFrame, labels: DataFrame, folds: int = 5) -> Model | None:
    """docs: doc_id, text; labels: doc_id, quality, toxic."""
    marks = labels.where((crc_mod("doc_id", folds) != 0) & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    marks = marks.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(ROWS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column(3).to_pylist()]
            buckets = [sorted({b for w in set(words(t)) for b in word_features(w)}) for t in texts]
            same = [xxhash.xxh3_64_intdigest(t.encode("utf-8", "replace")) >> 1 for t in texts]
            columns = [batch.column(0), batch.column(1).cast(pa.int32()), batch.column(2).cast(pa.int32()), pa.array(same, pa.int64()), pa.array([style(t) for t in texts], pa.list_(pa.float64())), pa.array(buckets, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "quality", "toxic", "same", "x", "f"])

    picked = docs.join(F.broadcast(marks), "doc_id").select("doc_id", "quality", "toxic", "text", F.xxhash64("text").alias("th"))  # broadcast: at most ROWS rows
    keys = picked.select("doc_id", "th").distinct().orderBy(F.xxhash64("doc_id", "th"), "doc_id", "th").limit(ROWS)  # the rows that go to the driver
    picked = picked.join(F.broadcast(keys), ["doc_id", "th"]).dropDuplicates(["doc_id", "th"]).select("doc_id", "quality", "toxic", "text")
    # kept as Arrow arrays: as Python objects the features would fill the driver
    got = picked.mapInArrow(rows, "doc_id bigint, quality int, toxic int, same bigint, x array<double>, f array<int>").toArrow().sort_by("doc_id")
    if not got.num_rows:
        return None
    _, first = np.unique(got["same"].to_numpy(), return_index=True)
    got = got.take(pa.array(np.sort(first))).combine_chunks()
    number = lambda c: got[c].to_numpy()
    low, toxic = (number("quality") == 0).astype(float), (number("toxic") == 1).astype(float)
    flat = lambda c: pa.concat_arrays([x.flatten() for x in got[c].chunks]).to_numpy()
    sizes = np.concatenate([x.value_lengths().to_numpy(zero_copy_only=False) for x in got["f"].chunks])
    return fit_chain(flat("x").reshape(-1, N_PLAIN), flat("f"), sizes, dict(zip(CATEGORIES, (low, toxic, low * toxic), strict=True)), (number("same") >> 7) % FOLDS)


def _probabilities(model: Model | None) -> Callable[[list[str | None]], np.ndarray]:
    if model is None:
        return lambda texts: np.tile([0.5, 0.0, 0.0], (len(texts), 1))
    find = finder(model)
    return lambda texts: predict(model, np.array([style(t) for t in texts]).reshape(-1, N_PLAIN), [find(t or "") for t in texts])


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and a probability for each category of every text. docs: doc_id, text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predicted = _probabilities(model)
        for batch in sliced(batches):
            p = predicted(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(p[:, i]) for i in range(p.shape[1])]], ["doc_id", *[f"p_{c}" for c in CATEGORIES]])

    return docs.mapInArrow(rows, "doc_id bigint, " + ", ".join(f"p_{c} double" for c in CATEGORIES))


def reject(df: DataFrame, labels: DataFrame) -> DataFrame:
    """df without its toxic rows."""
    model = train(df.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), labels)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predicted = _probabilities(model)
        for batch in sliced(batches):
            p = predicted(batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield batch.filter(pa.array(p[:, CATEGORIES.index("toxic")] < THRESHOLD))

    return df.mapInArrow(keep, df.schema)


def digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out = score(docs, train(docs, labels))
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), *[f"p_{c}" for c in CATEGORIES], (F.col("p_toxic") >= THRESHOLD).alias("toxic"))

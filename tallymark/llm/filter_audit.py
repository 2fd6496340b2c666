"""How filters interact: what each removes, in every order in which they may be applied.

1. Fingerprints: each task judges its texts by the filters on text alone, and merges copies that it holds (a copy of a
   smaller id in sight fails at once; of the rest one row a text goes on). Rows are routed by xxhash of the text to
   partitions sorted by it; there a chain of the texts that share a fingerprint, with their full text and least id, decides:
   every id above the least of its own text fails the duplicate filter, whatever a colliding text does.
2. What is left of a document is its id, its part and the set of filters that it fails, a mask. Labels join these slim
   rows.
3. ``combineByKey`` adds up, for each part, a vector: documents, good ones and toxic ones by mask (2^k each).
4. All orders, steps and Shapley sums are read off that vector: a filter removes what fails it and none before it.

Scale: texts are shuffled once, after the merging of copies in tasks, so a text that a third of all rows hold is one row
of each HELD characters of a task; decided rows are dealt evenly. A partition is sorted by spilling and holds only
the texts of one fingerprint at a time. The vectors have a fixed size, merged in tasks before they are shuffled.

Defined results: a null text is an empty one, a null part the empty string. Rows without an id take part but neither fail
the duplicate filter nor make others fail it. Rows that repeat an id and a text don't fail for each other. A document
is good or toxic if any label of its id says so; without labels it is neither. An empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: A task merges copies among so many characters of text at a time; a partition of the routed texts has about as many.
HELD = 32_000_000
_UPPER = bytes(range(65, 91))
_MARKS = re.compile(r"[#$%&*|]")
#: Documents, good ones, toxic ones.
KINDS = 3


def few_words(text: str) -> bool:
    return len(text.encode().split()) < 200


def repetitive(text: str) -> bool:
    words = text.encode().split()
    return 100 * len(set(words)) < 50 * len(words)


def shouting(text: str) -> bool:
    raw = text.encode()
    return 100 * (len(raw) - len(raw.translate(None, _UPPER))) > 2 * len(text)


def marked(text: str) -> bool:
    return _MARKS.search(text) is not None


#: Filters on text alone: letter -> does the text fail? The filter of duplicates, DUPLICATE, comes on top.
FILTERS: dict[str, Callable[[str], bool]] = {"A": few_words, "B": repetitive, "C": shouting, "D": marked}
DUPLICATE = "E"

Decided = tuple[int | None, str, int, int]  # id, part, mask, rows


def fingerprint(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode())


class Chain:
    """The different texts of one fingerprint, each with its least id so far and that id's rows by part. ``add`` yields
    what is decided already, ``rest`` the rows of the least ids."""

    def __init__(self, duplicate: int) -> None:
        self.duplicate, self.texts = duplicate, {}

    def add(self, text: str, doc: int, mask: int, rows: Counter) -> Iterator[Decided]:
        held = self.texts.get(text)
        if held is None or doc < held[0]:
            self.texts[text] = (doc, mask, Counter(rows))
            doc, rows = (None, ()) if held is None else (held[0], held[2])
        elif doc == held[0]:
            held[2].update(rows)
            return
        if doc is not None:
            yield from ((doc, part, mask | self.duplicate, n) for part, n in rows.items())

    def rest(self) -> Iterator[tuple[str, int, int, Counter]]:
        return ((text, *held) for text, held in self.texts.items())


def _judge(filters: dict[str, Callable[[str], bool]]):
    """Rows (id, text, part) to (key, value): (fingerprint, (id, mask, rows by part, text)), or (any key, decided)."""
    tests, duplicate = list(filters.values()), 1 << len(filters)

    def run(rows: Iterator[Row]) -> Iterator[tuple[int, tuple]]:
        chain, held, n = Chain(duplicate), 0, itertools.count()
        own = lambda d: (fingerprint(f"{next(n)} {d[0]}"), d)  # noqa: E731  # decided rows go anywhere, evenly
        for doc, text, part in rows:
            known = chain.texts.get(text)
            mask = known[1] if known else sum(1 << i for i, fails in enumerate(tests) if fails(text))
            if doc is None:
                yield own((None, part, mask, 1))
                continue
            held += 0 if known else len(text)
            yield from map(own, chain.add(text, doc, mask, Counter((part,))))
            if held > HELD:
                yield from ((fingerprint(t), (d, m, c, t)) for t, d, m, c in chain.rest())
                chain, held = Chain(duplicate), 0
        yield from ((fingerprint(t), (d, m, c, t)) for t, d, m, c in chain.rest())

    return run


def _chains(duplicate: int):
    """Pairs of ``_judge``, in order of their key, to what is decided of every document."""

    def run(pairs: Iterable[tuple[int, tuple]]) -> Iterator[Decided]:
        for _, some in itertools.groupby(pairs, key=lambda kv: kv[0]):
            chain = Chain(duplicate)
            for _, (doc, x, y, z) in some:
                if isinstance(z, str):
                    yield from chain.add(z, doc, x, y)
                else:
                    yield doc, x, y, z
            for _, doc, mask, rows in chain.rest():
                yield from ((doc, part, mask, n) for part, n in rows.items())

    return run


def masks(docs: DataFrame, filters: dict[str, Callable[[str], bool]] = FILTERS, id_column: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(doc_id, part, mask, rows): bit i of the mask is set if the i-th filter fails, the bit after these for duplicates."""
    spark, duplicate = docs.sparkSession, 1 << len(filters)
    slim = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(size / HELD))
    routed = slim.rdd.mapPartitions(_judge(filters)).repartitionAndSortWithinPartitions(parts, lambda key: key % parts)
    return spark.createDataFrame(routed.mapPartitions(_chains(duplicate)), "doc_id bigint, part string, mask int, rows bigint", verifySchema=False)


def report(vector: np.ndarray, letters: str) -> Iterator[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders, from the
    counts by kind and mask of one part."""
    k = len(letters)
    counts = np.asarray(vector, dtype=np.int64).reshape(KINDS, 1 << k)
    mask = np.arange(1 << k)
    clear = [(counts * ((mask & before) == 0)).sum(axis=1) for before in range(1 << k)]  # what passes a set of filters
    lost = {(i, before): clear[before] - clear[before | 1 << i] for i in range(k) for before in range(1 << k) if not before >> i & 1}
    orders = list(itertools.permutations(range(k)))
    shapley = Counter()
    for order in orders:
        before = 0
        for i in order:
            shapley[i] += int(lost[i, before][0])
            before |= 1 << i
    for order in orders:
        before = 0
        for step, i in enumerate(order, 1):
            removed, good, toxic = (int(x) for x in lost[i, before])
            fails = int(lost[i, 0][0])
            before |= 1 << i
            yield "".join(letters[j] for j in order), step, int(clear[before][0]), removed, fails - removed, int(counts[0, 1 << i]), good, toxic, shapley[i]


REPORT = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable[[str], bool]] = FILTERS, **columns: str) -> DataFrame:
    """A row for each part, order and step. k filters have k! orders: six at most, duplicates included."""
    letters = "".join(filters) + DUPLICATE
    if len(letters) > 6:
        raise ValueError(f"{len(letters)} filters have too many orders to list")
    size = 1 << len(letters)
    marks = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    decided = masks(docs, filters, **columns)
    # rows without an id would all meet in one task of the join: they have no label
    nameless = F.xxhash64("part", "mask", F.monotonically_increasing_id())
    keyed = decided.withColumns({"_null": F.col("doc_id").isNull(), "_id": F.coalesce("doc_id", nameless)})
    marks = marks.where("doc_id is not null").select(F.col("doc_id").alias("_id"), F.lit(False).alias("_null"), "good", "toxic")
    known = keyed.join(marks, ["_id", "_null"], "left").select("part", "mask", "rows", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))

    def add(vector: np.ndarray, row: tuple[int, int, int, int]) -> np.ndarray:
        mask, rows, good, toxic = row
        vector[[mask, size + mask, 2 * size + mask]] += (rows, rows * good, rows * toxic)
        return vector

    def create(row: tuple[int, int, int, int]) -> np.ndarray:
        return add(np.zeros(KINDS * size, dtype=np.int64), row)

    vectors = known.rdd.map(lambda r: (r[0], tuple(r)[1:])).combineByKey(create, add, lambda a, b: a + b)
    lines = vectors.flatMap(lambda kv: ((kv[0], *line) for line in report(kv[1], letters)))
    return docs.sparkSession.createDataFrame(lines, REPORT, verifySchema=False)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(docs, labels)

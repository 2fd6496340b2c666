"""Mixing sources to target weights by subset-sum budget fitting.

1. Every document's size in words; a table of how many documents of each source have each exact size.
2. Targets: all words are shared by weight, no source above ``most`` times its own words, the excess shared again by
   weight until none is above. The fixed point is min(cap, level x weight) with one common level, found in one pass
   over the sources by cap per weight.
3. A source's target is a number of whole copies of it plus a remainder below its size. The remainder is fitted on
   the size counts alone: an even share of each size's documents, then larger sizes first while they fit, and for
   what is left a bounded-knapsack dynamic programme that reaches the sum nearest to the budget.
4. So many documents of each size are then taken by a seeded hash, split in as many hash buckets as the table's rows
   ask for, so that no task ranks all documents of one size.

Only size counts ever meet in one task per source (a row for each exact length), and one row for each source in one
task for the targets; documents never do. Two reruns take the same documents: ranks
depend on the seed, the id and the text, buckets also on the row's place in the stored files, by which repeated rows spread.

Defined results: a null text has size 0; null sources are one source, last in order; documents of size 0 are taken 0
times; repeated rows are documents of their own; with no words at all every target is 0; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.common import PLACE, WORD_SQL, placed, staged

#: The dynamic programme runs over at most so many words (its table has a bit for each, per size).
BUDGET_WORDS = 1 << 16
#: Documents are dealt by hash to one bucket for so many of them: the number of buckets follows the table's rows, and even
#: where all are of one source and size, or one row repeated, a task ranks about so many at a time.
BUCKET_ROWS = 20_000


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD_SQL)), F.lit(0)).cast("bigint")


def _source_key(source: Column) -> Column:
    """Never null, in the order of the sources by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def targets(totals: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """(key, source_size) to (key, source_size, target). The only windows over all sources: a row for each."""
    all_rows = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(Window.orderBy("key")) - 1, F.lit(len(weights))) + 1)
    cap = F.col("source_size") * F.lit(float(most))
    df = totals.withColumn("w", w).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("w"))
    before = Window.orderBy("ratio", "key").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("all_w", F.sum("w").over(all_rows)).withColumn("all_size", F.sum("source_size").over(all_rows))
    left_w = F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    left = F.col("all_size") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    df = df.withColumn("level", left / left_w)
    # the first source, by cap per weight, that its level does not fill sets the level of all after it
    df = df.withColumn("level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(all_rows)["level"])
    return df.select("key", "source_size", F.when(F.col("ratio") <= F.col("level"), F.col("cap")).otherwise(F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size (ascending, above 0) to take so that their words come nearest to the budget."""
    total = int((sizes * counts).sum())
    if budget <= 0 or not len(sizes):
        return np.zeros_like(counts)
    if budget >= total:
        return counts.copy()
    take = np.array([int(c) * budget // total for c in counts], dtype=np.int64)
    left = budget - int((sizes * take).sum())
    for i in range(len(sizes) - 1, -1, -1):  # larger sizes first, down to what the programme handles
        if left <= BUDGET_WORDS // 2:
            break
        more = min(int(counts[i] - take[i]), (left - BUDGET_WORDS // 2) // int(sizes[i]) or int(left >= sizes[i]))
        take[i] += more
        left -= more * int(sizes[i])
    # Give back a few documents of the smaller sizes, so that there is something to combine.
    for i in range(len(sizes)):
        if left >= BUDGET_WORDS // 2:
            break
        back = min(int(take[i]), 8, (BUDGET_WORDS - left) // int(sizes[i]))
        take[i] -= back
        left += back * int(sizes[i])
    span = left + int(sizes[-1])  # sums a little above may be nearer
    reach, steps, bit = 1, [], 1 << min(left, BUDGET_WORDS)
    mask = (1 << (min(span, 2 * BUDGET_WORDS) + 1)) - 1
    for i in range(len(sizes)):
        spare, part = int(counts[i] - take[i]), 1
        while spare > 0 and not reach & bit:
            n = min(part, spare)
            if (shift := n * int(sizes[i])) > span:
                break
            steps.append((i, n, reach))
            reach |= (reach << shift) & mask
            spare, part = spare - n, part * 2
    near = _nearest(reach, left)
    for i, n, had in reversed(steps):
        if not had >> near & 1:
            take[i] += n
            near -= n * int(sizes[i])
    return take


def _nearest(reach: int, want: int) -> int:
    """The set bit nearest to ``want``; of two, the lower."""
    low = (reach & ((1 << (want + 1)) - 1)).bit_length() - 1
    above = reach >> want
    high = want + (above & -above).bit_length() - 1 if above else None
    return high if high is not None and high - want < want - low else low


def _fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows of one source: a size, its count, and the source's words and target."""
    pdf = pdf.sort_values("size")
    words, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    copies = int(target // words) if words else 0
    budget = round(target - copies * words)
    some = pdf["size"].to_numpy() > 0
    extra = np.zeros(len(pdf), dtype=np.int64)
    extra[some] = fit(pdf["size"].to_numpy()[some], pdf["n"].to_numpy()[some], budget)
    return pd.DataFrame({"key": pdf["key"], "size": pdf["size"], "source_size": words, "target": target, "copies": copies, "extra": extra})


def dealt(df: DataFrame, seed: int, source: str, text: str, id_column: str) -> DataFrame:
    """df with the key of its source, its size, and its rank and bucket within these."""
    rank = F.xxhash64(F.lit(seed), F.col(f"`{id_column}`").cast("string"), F.col(f"`{text}`"))
    slim = placed(df).withColumn("size", word_count(text)).withColumn("key", _source_key(F.col(f"`{source}`"))).withColumn("rank", rank)
    return slim.withColumn("bucket", F.pmod(F.xxhash64("rank", PLACE), F.lit(1 + df.count() // BUCKET_ROWS)))


def mix(df: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3, seed: int = 17, source: str = "source", text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """df with ``size``, ``source_size``, ``target`` and ``copies``: how often the mix takes the document (0 to most)."""
    slim = dealt(df, seed, source, text, id_column)
    by_bucket = slim.groupBy("key", "size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    by_bucket = staged(by_bucket, "mix-counts")
    by_size = by_bucket.groupBy("key", "size").agg(F.sum("n").alias("n"))
    totals = by_size.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    plan = by_size.join(targets(totals, weights, most), "key").groupBy("key").applyInPandas(_fit_source, "key string, size bigint, source_size bigint, target double, copies bigint, extra bigint")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quota = by_bucket.join(plan, ["key", "size"]).withColumn("quota", F.greatest(F.lit(0), F.least("n", F.col("extra") - before))).drop("extra", "n")
    nth = F.row_number().over(Window.partitionBy("key", "size", "bucket").orderBy("rank", f"`{id_column}`"))
    out = slim.join(quota, ["key", "size", "bucket"]).withColumn("place", nth)
    out = out.withColumn("copies", F.when(F.col("size") > 0, F.col("copies") + (F.col("place") <= F.col("quota")).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    own = [c for c in df.columns if c not in ("size", "source_size", "target", "copies")]
    return out.select(*[F.col(f"`{c}`") for c in own], "size", "source_size", "target", "copies")


def digest(df: DataFrame) -> DataFrame:
    slim = df.select("doc_id", "text", "source")
    return mix(slim).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))

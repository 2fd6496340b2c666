"""Distributions that can be merged: fixed-bucket histograms and quantile sketches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Upper bounds of the buckets of a duration, in seconds; a last bucket has none.
SECONDS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)
#: Of a sketch: its rank error is below 1.7 % with a probability of 0.99.
K = 200


def histogram(df: DataFrame, by: Sequence[str], column: str, bounds: Sequence[float] = SECONDS) -> DataFrame:
    """(by, le, n, total): how many values are in (bound before, le], with null for above all bounds, and how many there are.
    One aggregate of a number a bucket, whatever the rows; nulls do not count."""
    edges = sorted(bounds)
    upto = [F.count_if(F.col(column) <= e).alias(f"_{i}") for i, e in enumerate(edges)]
    counts = df.groupBy(*by).agg(*upto, F.count(column).alias("total"))
    each = [F.struct(F.lit(e).cast("double").alias("le"), (F.col(f"_{i}") - (F.col(f"_{i - 1}") if i else F.lit(0))).alias("n")) for i, e in enumerate(edges)]
    each.append(F.struct(F.lit(None).cast("double").alias("le"), (F.col("total") - F.col(f"_{len(edges) - 1}")).alias("n")))
    return counts.select(*by, "total", F.inline(F.array(*each)))


def merged_histograms(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Histograms of the same bounds, added up."""
    total = F.sum("n").alias("n")
    out = parts.groupBy(*by, "le").agg(total)
    return out.join(out.groupBy(*by).agg(F.sum("n").alias("total")), list(by))


def sketches(df: DataFrame, by: Sequence[str], column: str, k: int = K) -> DataFrame:
    """(by, sketch): a KLL sketch of each group's values, of a size that hardly grows with them; null for no values."""
    return df.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(column).cast("double"), k).alias("sketch"))


def merged_sketches(parts: DataFrame, by: Sequence[str], k: int = K) -> DataFrame:
    """Sketches of parts (days, batches) as one of each group."""
    return parts.groupBy(*by).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"))


def quantiles(sketched: DataFrame, **at: float) -> DataFrame:
    """sketched plus ``n`` and, for each name, the value at that rank."""
    values = {name: F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))) for name, p in at.items()}
    return sketched.withColumns({"n": F.kll_sketch_get_n_double("sketch"), **values}).drop("sketch")

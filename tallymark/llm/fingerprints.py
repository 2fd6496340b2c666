"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A text's terms are its words, weighted by how often they occur. For each sample k and term x, hashes of (x, k) give
two Gamma(2, 1) variates r and c and a uniform b; with t = floor(ln w / r + b), the term's value is
ln c - r (t - b + 1), and the sample is the (term, t) of the least value. Two texts agree on a sample with a probability
that equals their generalised Jaccard similarity, sum of min over sum of max of the weights, so the share of equal
samples estimates it without bias; its standard error is at most 0.5 / sqrt(samples).

A text is exploded into its distinct terms and aggregated at once by ``min`` over primitive longs (value above, hash of
(term, t) below), in one generated stage: no array of variates exists, and nothing is shuffled for it.

Neighbours by id: documents are dealt to buckets of consecutive (id, hash of text, place), whose number follows the rows of the
table (bounds from a range partitioning of these keys alone), and the first document of a bucket is also put, marked, at
the end of the one before; so the next document is always in the same bucket, each text is shuffled once, and an id that
very many texts share is cut like any range. A row finds its bucket by binary search. A bucket is sorted and streamed,
spilling if need be.

Defined results: null is the empty text; the empty text has the empty fingerprint, alike to itself (1.0) and to
nothing else (0.0); rows with equal ids follow each other by a hash of the text, then by their place; a null id comes first; a single document is its own
next; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.common import PLACE, placed

SAMPLES = 40
#: About so many documents make a bucket, up to so many buckets.
BUCKET_DOCS, BUCKETS = 512, 1 << 14


def word_hashes(text: Column) -> Column:
    """Sorted hashes of the words of the text, repeats kept."""
    return F.sort_array(F.transform(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""), lambda w: F.xxhash64(w)))


def _starts(hashes: Column) -> Column:
    """Where each distinct value of a sorted array begins."""
    at = F.sequence(F.lit(0), F.size(hashes) - 1)
    return F.when(F.size(hashes) > 0, F.filter(at, lambda i: (i == 0) | (hashes[i] != hashes[F.greatest(i - 1, F.lit(0))])))


def _sample(term: Column, log_weight: Column, k: int) -> Column:
    """The value of a term in sample k, order-preserving in the upper half of a long, above the hash of (term, t)."""
    h, g = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    u = (F.shiftrightunsigned(h, 32) + 0.5) * ((h.bitwiseAND(F.lit(0xFFFFFFFF)) + 0.5) * 2.0**-64)
    v = (F.shiftrightunsigned(g, 40) + 0.5) * ((F.shiftrightunsigned(g, 16).bitwiseAND(F.lit(0xFFFFFF)) + 0.5) * 2.0**-48)
    b = (g.bitwiseAND(F.lit(0xFFFF)) + 0.5) * 2.0**-16
    r = -F.log(u)
    t = F.floor(log_weight / r + b)
    value = F.log(-F.log(v)) - r * (t - b + 1.0)
    return F.shiftleft(((value + 192.0) * 2.0**22).cast("bigint"), 32).bitwiseOR(F.xxhash64(term, t).bitwiseAND(F.lit(0xFFFFFFFF)))


def sign(df: DataFrame, keys: list[str], text: str, samples: int = SAMPLES) -> DataFrame:
    """(keys, signature): the samples of each row's text as an array of longs, null for a text without words.
    ``keys`` must tell rows apart; they are carried through the aggregation."""
    terms = df.select(*keys, word_hashes(F.col(text)).alias("_h"))
    terms = terms.select(*keys, "_h", _starts(F.col("_h")).alias("_s"))
    terms = terms.select(*keys, "_h", "_s", F.posexplode_outer("_s").alias("_j", "_i"))
    end = F.coalesce(F.get(F.col("_s"), F.col("_j") + 1), F.size("_h"))
    terms = terms.select(*keys, F.get(F.col("_h"), F.col("_i")).alias("_x"), F.log((end - F.col("_i")).cast("double")).alias("_w"))
    signed = terms.groupBy(*keys).agg(F.max(F.col("_x").isNotNull()).alias("_some"), *[F.min(_sample(F.col("_x"), F.col("_w"), k)).alias(f"_m{k}") for k in range(samples)])
    return signed.select(*keys, F.when(F.col("_some"), F.array(*[F.col(f"_m{k}") for k in range(samples)])).alias("signature"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of equal samples; two empty texts are alike, an empty and another are not."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(samples))
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(same)


def fingerprint(signature: Column) -> Column:
    """Eight hexadecimal digits a sample; the empty string for a text without words."""
    return F.coalesce(F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), ""), F.lit(""))


_KEY = "array<struct<k:bigint,h:bigint,s:bigint>>"


def cuts(keys: DataFrame, buckets: int) -> list[tuple[int, int, int]]:
    """The first key of every bucket but the first: so many ranges of about equal numbers of rows. keys: k, h, s. A row for
    each bucket comes to the driver."""
    ranged = keys.repartitionByRange(buckets, "k", "h", "s").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("k", "h", "s")).alias("low"))
    return sorted({tuple(r["low"]) for r in ranged.collect()})[1:]


def _table(keys: list[tuple[int, int, int]]) -> Column:
    return F.from_json(F.lit(json.dumps([dict(zip("khs", key, strict=True)) for key in keys])), _KEY)


def bucket_of(key: Column, bounds: list[tuple[int, int, int]]) -> Column:
    """How many of the bounds (ascending) are at or below the key, a struct of three longs: by binary search."""
    if not bounds:
        return F.lit(0)
    table = _table(bounds)
    span = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        below = (s["low"] < s["high"]) & (F.get(table, middle) <= key)
        high = F.when((s["low"] < s["high"]) & ~below, middle).otherwise(s["high"])
        return F.struct(F.when(below, middle + 1).otherwise(s["low"]).alias("low"), high.alias("high"))

    steps = len(bounds).bit_length()
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), span, halve, lambda s: s["low"])


def buckets_for(rows: int) -> int:
    """A bucket for BUCKET_DOCS rows; BUCKETS at most, for whose bounds Spark samples 100 keys each in the driver. Beyond that buckets
    grow: their rows are sorted by Spark, which spills, and pass a window that looks one row ahead."""
    return max(1, min(-(-rows // BUCKET_DOCS), BUCKETS))


def with_next(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(bucket, place, doc_id, text, next_text, extra): rows in the order of ids, with the text after each. Rows with
    ``extra`` repeat the first of the next bucket (of the first, at the very end). Rows that repeat an id are in order of
    a hash of their text, then of their place, so one row repeated very often is cut into buckets like any range."""
    df = placed(df.select(f"`{id_column}`", f"`{text}`"))
    slim = df.select(F.col(f"`{id_column}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.col(PLACE).alias("s"))
    slim = slim.select(F.coalesce("doc_id", F.lit(-(1 << 63)).cast("bigint")).alias("k"), F.xxhash64("text").alias("h"), "s", "doc_id", "text")
    key = F.struct("k", "h", "s")
    rows = slim.count()
    buckets = buckets_for(rows)
    bounds = cuts(slim.select("k", "h", "s"), buckets) if buckets > 1 else []
    low = slim.agg(F.min(key).alias("low")).first()["low"] if rows else None
    slim = slim.select(bucket_of(key, bounds).alias("bucket"), "k", "h", "s", "doc_id", "text")
    # a bound is the key of a row: the rows whose keys are bounds come first in their buckets
    starts = [tuple(low), *bounds] if rows else []
    heads = slim.where(F.struct("k", "h", "s") == F.get(_table(starts), F.col("bucket"))).groupBy("bucket", "k", "h", "s", "doc_id").agg(F.min("text").alias("text"))
    ends = heads.select(F.when(F.col("bucket") == 0, F.lit(len(bounds))).otherwise(F.col("bucket") - 1).alias("bucket"), "k", "h", "s", "doc_id", "text", F.lit(True).alias("extra"))
    order = Window.partitionBy("bucket").orderBy("extra", "k", "h", "s", "text")
    both = slim.withColumn("extra", F.lit(False)).unionByName(ends)
    return both.select("bucket", F.row_number().over(order).alias("place"), "doc_id", "text", F.lead("text").over(order).alias("next_text"), "extra")


def digest(df: DataFrame, samples: int = SAMPLES) -> DataFrame:
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce(F.col("next_text"), F.lit("")), F.lit(1), half))
    docs = with_next(df).withColumn("edited", edited)
    docs = docs.select("bucket", "place", "doc_id", "extra", n.cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.explode(F.array(F.struct(F.lit(0).alias("version"), F.col("text").alias("body")), F.struct(F.lit(1).alias("version"), F.col("edited").alias("body")))).alias("v"))
    keys = ["bucket", "place", "doc_id", "extra", "n_chars", "edited_sha256", "version"]
    signed = sign(docs.select(*keys[:-1], "v.version", "v.body"), keys, "body", samples)
    order = Window.partitionBy("bucket").orderBy("place", "version")
    signed = signed.withColumn("e", F.lead("signature", 1).over(order)).withColumn("x", F.lead("signature", 2).over(order)).where("version = 0 and not extra")
    own = F.col("signature")
    return signed.select("doc_id", "n_chars", "edited_sha256", fingerprint(own).alias("fingerprint"), fingerprint(F.col("e")).alias("edited_fingerprint"), likeness(own, F.col("e"), samples).alias("near_edited"), likeness(own, F.col("x"), samples).alias("near_next"))

"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.sources.store import stage_root, stored

__all__ = ["PLACE", "WORD_SQL", "crc_mod", "documents", "lower_ascii", "maybe_in", "only", "placed", "sliced", "stage_root", "staged", "words"]

#: A word is a run of anything but ASCII white space.
WORD_SQL = r"[^\x20\x09-\x0D]+"


def lower_ascii(text: str) -> str:
    """Lower-case A-Z only; every other code point stays."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def words(text: str) -> list[str]:
    """The words of the text; bytes are split at just the white space that ends a word."""
    parts = text.encode("utf-8", "surrogatepass").split()
    return b" ".join(parts).decode("utf-8", "surrogatepass").split(" ") if parts else []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows, so that few texts at a time become Python objects."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def crc_mod(column: str, m: int) -> Column:
    """crc32 of the column written as text, modulo m (null stays null)."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(m))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: later steps neither recompute it nor depend on
    an executor that may be lost."""
    return stored(df, name)


#: The column that ``placed`` adds.
PLACE = "_place_of_row"


def placed(df: DataFrame) -> DataFrame:
    """df with PLACE, a number that tells rows apart which agree in all columns, so that many of them need not go to one task:
    by a row's place in its file, whatever the folder and the run's own part of the file's name. Rows that are not read
    from files which know it are stored first, so a row has one number however often it is computed. Two rows may share a
    number: nothing but the dealing of rows may depend on it."""
    try:
        df.select("_metadata.file_name", "_metadata.row_index")
    except AnalysisException:
        df = staged(df, "placed")
    return df.withColumn(PLACE, F.xxhash64(F.regexp_replace("_metadata.file_name", r"^(part-\d+).*$", "$1"), "_metadata.row_index"))


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns, whatever else the table holds."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


#: Words of a bitmap of keys: at most so many (a broadcast of some 100 MB), which are 16 bits a key for 16 million keys.
FILTER = 1 << 22


def maybe_in(df: DataFrame, keys: DataFrame, *key: str) -> DataFrame:
    """df with ``maybe``: false where ``keys`` surely lacks the row's key. A bitmap of 16 bits a key is broadcast, so of the
    rows that a join does not concern one in sixteen is shuffled for it. Beyond FILTER words it grows no more, and more of
    these rows say maybe: the join is as right, what it moves comes nearer to all rows."""
    words = 1 << max(10, min(FILTER.bit_length() - 1, (keys.count() // 4).bit_length()))
    word, bit = F.pmod(F.xxhash64(*key), F.lit(words)).cast("int"), F.pmod(F.xxhash64(*key[::-1], F.lit(1)), F.lit(64)).cast("int")
    mark = F.expr("shiftleft(1L, _bit)")
    marks = keys.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or(mark).alias("_marks"))
    marked = df.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(marks), "_word", "left")
    return marked.withColumn("maybe", F.coalesce(F.col("_marks").bitwiseAND(mark) != 0, F.lit(False))).drop("_word", "_bit", "_marks")

"""Tables between steps, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tallymark.sources import files


def stage_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset a local session gets a temporary folder; on a cluster executors would
    each write to their own disk, so there it is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tallymark-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


#: Spark deletes the shuffles of a query at its end, not when the driver next collects its garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle on the disks."""
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(DROP_SHUFFLES, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table and read again: a cut of the plan that survives a lost executor, and after which the shuffles
    before it are gone."""
    return _stored(df, name)[0]


def _stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def stored_meanwhile(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``stored``, and deleted at the end of the block."""
    table, path = _stored(df, name)
    try:
        yield table
    finally:
        files.delete(df.sparkSession, path)


def one_a_key(df: DataFrame) -> DataFrame:
    """df, for a join on keys that it has about as many of as there are orders: never sent whole through the driver. Spark takes the
    size of some columns for their share of the row's nominal width, in which a VARIANT is 2 kB, and so holds millions of rows
    for a few megabytes where the table has ``items``."""
    return df.hint("merge")

"""Small files beside a table, through Hadoop's file systems: whatever Spark reads from."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Exists(RuntimeError):
    """The file is there already."""


def _open(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """What the folder holds, in order, without hidden files; nothing if there is no such folder."""
    at, fs = _open(spark, folder)
    found = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(n for n in found if not n.startswith(("_", ".")))


def text_of(spark: SparkSession, path: str) -> str:
    at, fs = _open(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    """The file or the folder with all that it holds, if there is one."""
    at, fs = _open(spark, path)
    fs.delete(at, True)


def put_new(spark: SparkSession, folder: str, name: str, text: str) -> None:
    """The file under its name, whole, or Exists: written aside and renamed. The rename is atomic on HDFS and stores like it; on
    a local disk Hadoop looks for the target and then renames, which leaves a gap of microseconds between two processes."""
    target, fs = _open(spark, f"{folder}/{name}")
    temp = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_{uuid.uuid4().hex}")
    fs.mkdirs(target.getParent())
    out = fs.create(temp, False)
    out.write(bytearray(text.encode()))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    never = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(temp), fs.makeQualified(target), never)
    except Py4JJavaError as e:
        fs.delete(temp, False)
        if "FileAlreadyExistsException" in str(e.java_exception):
            raise Exists(f"{folder}/{name}") from None
        raise

"""A table's declared schema, in versions beside its data.

Columns may be added if they may be null; nothing else may change. Rows are held to the declared schema before they are
written, and all days are read by it, so that old and new days are one table.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallymark.sources import files

FOLDER = "_contract"


class ContractBroken(ValueError):
    """A schema, or rows, that the declared one does not allow."""


def versions(spark: SparkSession, path: str) -> list[int]:
    return [int(n.removesuffix(".json")) for n in files.names(spark, f"{path}/{FOLDER}")]


def declared(spark: SparkSession, path: str, version: int | None = None) -> StructType:
    """The schema of a version, the newest by default."""
    known = versions(spark, path)
    if not known or version is not None and version not in known:
        raise ContractBroken(f"{path} declares no schema" if not known else f"{path} has no version {version}")
    return StructType.fromJson(json.loads(files.text_of(spark, f"{path}/{FOLDER}/{version or known[-1]:06d}.json")))


def refusals(old: StructType, new: StructType) -> list[str]:
    """Why the new schema may not follow the old one; nothing if it may. The order of columns is free."""
    before, after = {f.name: f for f in old}, {f.name: f for f in new}
    out = [f"{n} is gone" for n in before if n not in after]
    for n, f in after.items():
        if n not in before:
            out += [] if f.nullable else [f"{n} is new and may not be null"]
        elif f.dataType != before[n].dataType:
            out.append(f"{n} was {before[n].dataType.simpleString()}, is {f.dataType.simpleString()}")
        elif before[n].nullable and not f.nullable:
            out.append(f"{n} might be null, may not now")
    return out


def declare(spark: SparkSession, path: str, schema: StructType) -> int:
    """Declares the schema: the version that has it. The first, the newest again if it is the same, or one more if it only adds
    columns that may be null or lets a column be null; else raises ContractBroken, and so if another declares at the same time."""
    known = versions(spark, path)
    if known:
        old = declared(spark, path)
        if old == schema:
            return known[-1]
        if why := refusals(old, schema):
            raise ContractBroken(f"{path}: {'; '.join(why)}")
    number = known[-1] + 1 if known else 1
    try:
        files.put_new(spark, f"{path}/{FOLDER}", f"{number:06d}.json", schema.json())
    except files.Exists as e:
        raise ContractBroken(f"version {number} of {path} was declared meanwhile") from e
    return number


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """df as the schema says: its columns in that order, absent ones null. Columns that it lacks, other types, and absent
    columns that may not be null raise at once; nulls in such columns raise when the rows are computed."""
    wanted, here = {f.name: f for f in schema}, {f.name: f for f in df.schema}
    bad = [f"{n} is not declared" for n in here if n not in wanted]
    bad += [f"{n} is {here[n].dataType.simpleString()}, not {f.dataType.simpleString()}" for n, f in wanted.items() if n in here and here[n].dataType != f.dataType]
    bad += [f"{n} is absent" for n, f in wanted.items() if n not in here and not f.nullable]
    if bad:
        raise ContractBroken("; ".join(bad))

    def column(name: str):
        c = F.col(f"`{name}`") if name in here else F.lit(None).cast(wanted[name].dataType)
        return c if wanted[name].nullable else F.coalesce(c, F.raise_error(F.lit(f"{name} is null")).cast(wanted[name].dataType))

    return df.select(*[column(n).alias(n) for n in wanted])

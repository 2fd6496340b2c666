"""A data source for tables stored by day that can't be scanned whole.

    spark.dataSource.register(DayTables)
    spark.read.format("tallymark_days").schema(schema).load(path).where("day >= date'2024-01-05'")

The filters on the day reach the source, which lists the folders of these days alone. A query with other filters only is
refused when it is planned, one without any when its partitions are asked for: before a task starts. Any other filter is left
to Spark. Needs ``spark.sql.python.filterPushdown.enabled``; without it every
query is refused. Files are read as Arrow batches, a task a file; columns that a file lacks are null. The path is one that
Arrow's file systems know.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_HOLDS = {
    EqualTo: lambda d, v: d == v,
    In: lambda d, v: d in v,
    GreaterThan: lambda d, v: d > v,
    GreaterThanOrEqual: lambda d, v: d >= v,
    LessThan: lambda d, v: d < v,
    LessThanOrEqual: lambda d, v: d <= v,
}


class File(InputPartition):
    def __init__(self, path: str, day: dt.date) -> None:
        self.path, self.day = path, day


class DayTables(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tallymark_days"

    def schema(self) -> StructType:
        raise ValueError("say the schema of the table, its day included")

    def reader(self, schema: StructType) -> DataSourceReader:
        return DayReader(self.options["path"], schema, self.options.get("day", "day"))


class DayReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, day: str) -> None:
        self.path, self.fields, self.day, self.filters = path, schema, day, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in _HOLDS and f.attribute == (self.day,):
                self.filters.append(f)
            else:
                yield f
        self._refuse()

    def _refuse(self) -> None:
        if not self.filters:
            raise ValueError(f"{self.path} is stored by {self.day}; say which days to read")

    def partitions(self) -> list[File]:
        self._refuse()
        system, root = pafs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")
        out = []
        for folder in system.get_file_info(pafs.FileSelector(root)):
            value = folder.base_name.removeprefix(f"{self.day}=")
            if value == folder.base_name or value.startswith("__"):  # no day, or the null one
                continue
            day = dt.date.fromisoformat(value)
            if all(_HOLDS[type(f)](day, f.value) for f in self.filters):
                out += [File(f.path, day) for f in system.get_file_info(pafs.FileSelector(folder.path, recursive=True)) if f.base_name.endswith(".parquet")]
        return out

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        system, _ = pafs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")
        wanted = to_arrow_schema(self.fields)
        with system.open_input_file(partition.path) as f:
            file = pq.ParquetFile(f)
            there = set(file.schema_arrow.names)
            for batch in file.iter_batches(columns=[n for n in wanted.names if n in there]):
                columns = [pa.array([partition.day] * len(batch), x.type) if x.name == self.day else batch.column(x.name).cast(x.type) if x.name in there else pa.nulls(len(batch), x.type) for x in wanted]
                yield pa.RecordBatch.from_arrays(columns, schema=wanted)

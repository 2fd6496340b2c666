"""Day-partitioned staging tables: fused reads, watermarks, incremental overwrite, backfill, reconciliation."""

from __future__ import annotations

import datetime as dt
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallymark import contracts as C


class MissingDayPredicate(ValueError):
    """A partitioned table was to be read without a range of days."""


def day_range(at: Column, start: dt.date, end: dt.date | None = None) -> Column:
    """[start, end) in whole days, UTC; the end defaults to the day after."""
    return (at >= F.lit(start).cast("timestamp_ntz")) & (at < F.lit(end or start + dt.timedelta(days=1)).cast("timestamp_ntz"))


def lookback(at: Column, as_of: Column, days: int = C.LOOKBACK_DAYS) -> Column:
    """From the start of the day ``days`` before as_of: only whole days, or a day would be replaced by a part of it."""
    return at >= F.date_sub(F.to_date(as_of), days).cast("timestamp_ntz")


def read_days(spark: SparkSession, path: str, start: dt.date | None = None, end: dt.date | None = None, day: str = "day", schema: StructType | None = None) -> DataFrame:
    """A staged table's days [start, end): the predicate is on the partition column, so no file of another day is read.
    Where columns were added over time give the ``schema``; without it Spark takes that of one file, and opens no other."""
    if start is None:
        raise MissingDayPredicate(f"{path} is partitioned by {day}; say which days to read")
    df = (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
    return df.where((F.col(day) >= F.lit(start)) & (F.col(day) < F.lit(end or start + dt.timedelta(days=1))))


def days_of(spark: SparkSession, path: str, day: str = "day") -> list[dt.date]:
    """The days of a staged table, in order, by the names of its partitions: no file is opened. None for no table."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return []
    names = [f.getPath().getName() for f in files.listStatus(at) if f.isDirectory()]  # a name a day
    values = [n.removeprefix(f"{day}=") for n in names if n.startswith(f"{day}=")]
    return sorted(dt.date.fromisoformat(v) for v in values if not v.startswith("__"))


def watermark(spark: SparkSession, path: str, day: str = "day") -> dt.date | None:
    """The newest day of a staged table, from its partitions' names alone; null ones do not count; None if there is none."""
    return max(days_of(spark, path, day), default=None)


def lookup(df: DataFrame, key: str, *values: object) -> DataFrame:
    """The rows of a few keys: pushed to the scan, which skips row groups by their bounds where the table is sorted by key, and by
    Bloom filters where it was written with ``look_up``."""
    return df.where(F.col(key).isin(*values))


def since(df: DataFrame, at: str, mark: dt.date | None) -> DataFrame:
    """Rows from the watermark's day on (again: late rows of that day must not be lost); all if there is none."""
    return df if mark is None else df.where(F.col(at) >= F.lit(mark).cast("timestamp_ntz"))


def append_days(df: DataFrame, path: str, at: str, cluster: list[str], day: str = "day", **files) -> None:
    _writer(df, at, cluster, day, **files).mode("append").parquet(path)


def overwrite_days(df: DataFrame, path: str, at: str, cluster: list[str], day: str = "day", **files) -> None:
    """Replaces the days that df holds and no others."""
    _writer(df, at, cluster, day, **files).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def overwrite_all(df: DataFrame, path: str, at: str, cluster: list[str], day: str = "day", **files) -> None:
    _writer(df, at, cluster, day, **files).mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def _writer(df: DataFrame, at: str, cluster: list[str], day: str, file_bytes: int = C.FILE_BYTES, look_up: dict[str, int] | None = None) -> DataFrameWriter:
    """Files of about ``file_bytes`` (as held in memory), each with a range of the first cluster key and sorted by all of them,
    so that files and row groups can be skipped by their bounds. Columns in ``look_up`` get Bloom filters for so many different
    values a file, by which row groups are skipped where a key is not one of the cluster's."""
    w = clustered(df.withColumn(day, F.to_date(at)), day, cluster, file_bytes).write.partitionBy(day)
    for column, values in (look_up or {}).items():
        w = w.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.expected.ndv#{column}", str(values))
    return w


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes in a task that sorts it: a word for the nulls and one a column, whatever its type, texts in
    whole words, and 32 for the row's length and its entries in the sort, of which there are two copies."""
    wide = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) + 7 for c, t in df.dtypes if t in ("string", "binary")]
    nested = [F.coalesce(F.size(F.col(f"`{c}`")), F.lit(0)) * 64 for c, t in df.dtypes if t.startswith(("array", "map"))]
    return reduce(Column.__add__, [*wide, *nested], F.lit(40 + 8 * len(df.columns))).cast("bigint")


def _ordinal(df: DataFrame, column: str) -> Column:
    """A number in the order of the column: of texts by their first seven bytes."""
    kind, c = dict(df.dtypes)[column], F.col(f"`{column}`")
    if kind in ("string", "binary"):
        return F.conv(F.rpad(F.hex(F.substring(c.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("double")
    if kind.startswith("timestamp") or kind == "date":
        return F.unix_micros(c.cast("timestamp")).cast("double")
    return c.cast("double")


#: Bounds that a day's sketch is asked for; with more files than that several share a range.
GRID = 1000


def clustered(df: DataFrame, day: str, cluster: list[str], file_bytes: int) -> DataFrame:
    """df in a partition a file to write, but for small days, which share one: each day in as many as its own bytes ask for, by
    ranges of the first cluster key whose bounds are quantiles of the day (a sketch); rows of a key that fills several files
    are spread over these, by its share of each. The driver sees a row a day, tasks a bound a file."""
    rows = df.withColumn("_key", F.coalesce(_ordinal(df, cluster[0]), F.lit(float("-inf"))))
    size = F.sum(row_bytes(df))
    days = rows.groupBy(day).agg(size.alias("size"), F.greatest(F.lit(1), F.ceil(size / file_bytes)).cast("int").alias("n"), F.kll_sketch_agg_double("_key", 8000).alias("_sketch"))
    grid = F.array(*[F.lit(i / GRID) for i in range(1, GRID)])
    days = days.select(day, "size", "n", F.when(F.col("n") > 1, F.kll_sketch_get_quantile_double("_sketch", grid)).alias("_grid")).orderBy(day).collect()  # a row a day
    spark, parts, room, found = df.sparkSession, 0, 0, []
    for d in days:
        grid, n = d["_grid"] or [], d["n"]
        if n == 1 and d["size"] <= room:  # small days share a task, which writes a file for each
            room -= d["size"]
            found.append((d[day], parts - 1, n, [], []))
            continue
        frequent = {k: (grid.index(k) * n / GRID, (GRID - 1 - grid[::-1].index(k)) * n / GRID) for k, times in Counter(grid).items() if times > 1}
        found.append((d[day], parts, n, [grid[max(0, round(i * GRID / n) - 1)] for i in range(1, n)], [(k, *ends) for k, ends in frequent.items()]))
        parts += n
        room = file_bytes - d["size"] if n == 1 else 0
    table = spark.createDataFrame(found, f"_day {dict(df.dtypes)[day]}, _first int, _n int, _bounds array<double>, _frequent array<struct<k:double,low:double,high:double>>")
    own, draw = F.get(F.filter("_frequent", lambda f: f["k"] == F.col("_key")), F.lit(0)), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20)) / (1 << 20)
    within = F.least(F.floor(own["low"] + draw * (own["high"] - own["low"])), F.col("_n") - 1)
    nth = F.when(own.isNull(), F.size(F.filter("_bounds", lambda b: b < F.col("_key")))).otherwise(within)
    placed = rows.join(F.broadcast(table), F.col(f"`{day}`").eqNullSafe(F.col("_day"))).withColumn("_file", (F.col("_first") + nth).cast("int"))
    return placed.repartitionById(max(1, parts), F.col("_file")).sortWithinPartitions(day, *cluster).select(*df.columns)


def expire_days(spark: SparkSession, path: str, before: dt.date, day: str = "day") -> list[dt.date]:
    """Deletes the partitions of days before the given one; returns these days. Null days stay."""
    old = [d for d in days_of(spark, path, day) if d < before]
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for d in old:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{day}={d.isoformat()}"), True)
    return old


def reconcile(left: DataFrame, right: DataFrame, at: str, key: str) -> DataFrame:
    """Days on which the distinct keys of left and the rows of right differ."""
    a = left.groupBy(F.to_date(at).alias("day")).agg(F.countDistinct(key).alias("left_keys"))
    b = right.groupBy(F.to_date(at).alias("day")).agg(F.count(F.lit(1)).alias("right_rows"))
    return a.join(b, "day", "full").where(~F.col("left_keys").eqNullSafe(F.col("right_rows")))


def landing_gate(offered: DataFrame, landed: DataFrame, key: str = "batch", least: float = 1.0) -> DataFrame:
    """(key, offered, landed, verdict) of what was offered and what landed: counts a batch, of both sides. Short: less than the
    share ``least`` landed; over: more than was offered; unknown: one of the two numbers is not known. All else passes."""
    a, b = (df.groupBy(key).agg(F.sum("n").alias(name)) for df, name in ((offered, "offered"), (landed, "landed")))
    both = a.withColumnRenamed(key, "_a").join(b.withColumnRenamed(key, "_b"), F.col("_a").eqNullSafe(F.col("_b")), "full")
    n, m = F.col("offered"), F.col("landed")
    verdict = F.when(n.isNull() | m.isNull(), "unknown").when(m > n, "over").when(m < n * least, "short").otherwise("pass")
    return both.select(F.coalesce("_a", "_b").alias(key), "offered", "landed", verdict.alias("verdict"))


def freshness(df: DataFrame, at: str, as_of: Column, warn_hours: int = 26, error_hours: int = 50, days: int = 30) -> DataFrame:
    """One row: the last instant of the window, its age in hours, pass, warn or error."""
    age = (F.unix_seconds(as_of) - F.unix_seconds(F.max(F.col(at).cast("timestamp")))) / 3600
    df = df.where(F.col(at).cast("timestamp") >= as_of - F.make_dt_interval(F.lit(days)))
    return df.agg(F.max(at).alias("last_at"), age.alias("age_hours")).withColumn("state", F.when(F.col("age_hours").isNull() | (F.col("age_hours") > error_hours), "error").when(F.col("age_hours") > warn_hours, "warn").otherwise("pass"))


def stuck_after(scan: int = 60, pending: int = 60, stale: int = 600, slack: int = 240) -> int:
    """Seconds after which a record that is still pending means that nobody works on them."""
    return max(pending + scan, stale + scan) + slack


def queue_health(raw: DataFrame, as_of: Column, threshold: int | None = None) -> DataFrame:
    """One row: pending records, those past the threshold, age of the oldest in seconds."""
    age = F.unix_seconds(as_of) - F.unix_seconds(F.col("received_at").cast("timestamp"))
    limit = stuck_after() if threshold is None else threshold
    return raw.where("status = 'pending'").agg(F.count(F.lit(1)).alias("pending"), F.count_if(age > limit).alias("stuck"), F.max(age).alias("oldest_seconds"))


def waiting(raw: DataFrame, as_of: Column, grace: int = 60, stale: int = 600) -> DataFrame:
    """Records to work on again: pending past the grace, or in work for too long."""
    old = lambda c, s: F.unix_seconds(as_of) - F.unix_seconds(F.col(c).cast("timestamp")) > s
    return raw.where(((F.col("status") == "pending") & old("received_at", grace)) | ((F.col("status") == "processing") & old("processing_started_at", stale)))


def recoverable(raw: DataFrame, as_of: Column, after_id: int = 0, page: int = 5000, grace: int = 60, stale: int = 600) -> DataFrame:
    """A page of ``waiting`` records, by id."""
    return waiting(raw, as_of, grace, stale).where(F.col("id") > after_id).orderBy("id").limit(page)

"""Streams: landing order documents, and counts over time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType

from tallymark.operators import distributions, events, ingest, retries, rules
from tallymark.operators.staging import waiting
from tallymark.sources.manifest import Manifest, Version
from tallymark.sources.store import one_a_key, stored, stored_meanwhile


def documents_in(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """A stream of files of JSON, one order a line, each with the instant at which its file arrived."""
    lines = spark.readStream.options(**options).text(folder)
    return lines.select(F.col("_metadata.file_modification_time").alias("received_at"), F.col("value").alias("raw_payload"))


def read_once(source: DataFrame) -> DataFrame:
    """The records as flat orders with their drift and with ``status`` processed or error: all that is ever read of the JSON."""
    return ingest.drift(ingest.flatten(ingest.parse(source))).drop("v", "odd")


#: Words of bits, a bit a record of a batch, that say in all tasks which records are new orders (some 130 MB at most); a batch of more
#: records is shuffled.
WORDS = 1 << 22
#: A record's id holds its batch, its file in the batch and its row in the file.
_FILE_BITS, _ROW_BITS = 14, 27


def _numbered(rows: DataFrame, files: list[str], batch: int) -> DataFrame:
    """rows (with ``file`` and ``row``) with their ids; equal lines of a file have ids of their own."""
    if len(files) >= 1 << _FILE_BITS or batch >= 1 << (63 - _FILE_BITS - _ROW_BITS):
        raise ValueError(f"batch {batch} of {len(files)} files: ids have no room for it")
    spark = rows.sparkSession
    numbers = spark.createDataFrame([(f, (batch << (_FILE_BITS + _ROW_BITS)) + (i << _ROW_BITS)) for i, f in enumerate(files)], "file string, _base bigint")
    room = F.when(F.col("row") < 1 << _ROW_BITS, F.col("_base") + F.col("row")).otherwise(F.raise_error(F.lit("a file has too many rows")))
    return rows.join(F.broadcast(numbers), "file").withColumn("id", room).drop("_base")  # a row a file of the batch


def with_new_keys(rows: DataFrame) -> DataFrame:
    """The stream's records, and a row (``new``) for each order that no earlier batch had. Spark's own state holds the orders'
    ids; all else about them is decided in the batch, by joins."""
    slim = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), "received_at", "order_id", "status", "error_message")
    keys = slim.where("status = 'processed'").select("order_id").dropDuplicates(["order_id"])
    return slim.withColumn("new", F.lit(False)).unionByName(keys.withColumn("new", F.lit(True)), allowMissingColumns=True)


def judge(batch: DataFrame) -> DataFrame:
    """Records with ids and rows ``new`` to (id, file, row, order_id, status, error_message): of each new order the first by
    (received_at, id) is processed, all other readable records are duplicates."""
    records = batch.where("not new")
    first = records.where("status = 'processed'").groupBy("order_id").agg(F.min(F.struct("received_at", "id")).alias("first"))
    won = first.join(one_a_key(batch.where("new").select("order_id")), "order_id", "left_semi").select(F.col("first.id").alias("id"), F.lit(True).alias("won"))
    status = F.when(F.col("status") == "error", "error").when(F.col("won"), "processed").otherwise("duplicate")
    message = F.when(status == "duplicate", F.concat(F.lit("already landed: "), "order_id")).otherwise(F.col("error_message"))
    return records.join(one_a_key(won), "id", "left").select("id", "file", "row", "order_id", status.alias("status"), message.alias("error_message"))


def only_of(rows: DataFrame, ids: DataFrame, records: int) -> DataFrame:
    """rows whose id is among the ids, of a batch of so many records. The rows are not shuffled: ids of a batch are dense, so bits
    hold them."""
    if records > 64 * WORDS:
        return rows.join(one_a_key(ids), "id", "left_semi")
    word, bit = F.shiftright("id", 6), F.col("id").bitwiseAND(F.lit(63)).cast("int")
    marks = ids.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_marks"))
    return rows.withColumn("_word", word).join(F.broadcast(marks), "_word").where(F.getbit("_marks", bit) == 1).drop("_word", "_marks")


def land_batch(batch: DataFrame, number: int, root: str, schema: StructType, work: retries.Work | None = None) -> None:
    """One micro-batch of ``with_new_keys`` into the manifest at ``root``: orders, events and a status for every record, in one
    commit. ``work`` may fail records (``retries``): these wait with their attempts or become dead letters."""
    with stored_meanwhile(batch, "landing-batch") as batch:  # the state is asked once
        files = sorted(r[0] for r in batch.where("not new").select("file").distinct().collect())  # of one trigger
        if not files:
            return
        keys = batch.where("new").withColumn("id", F.lit(None).cast("bigint"))
        with stored_meanwhile(judge(_numbered(batch.where("not new"), files, number).unionByName(keys)), "judged-batch") as judged:
            _commit(judged, files, number, root, schema, work)


def _commit(judged: DataFrame, files: list[str], number: int, root: str, schema: StructType, work: retries.Work | None) -> None:
    spark, m = judged.sparkSession, Manifest(judged.sparkSession, root)
    counts = {r[0]: r[1] for r in judged.groupBy("status").count().collect()}
    rows = spark.read.schema(schema).parquet(*files).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    good = _numbered(rows.where("status = 'processed'"), files, number)
    good = only_of(good, judged.where("status = 'processed'").select("id"), sum(counts.values())).drop("file", "row", "raw_payload", "status", "error_message")
    ods = rules.evaluate(rules.normalise(good.withColumnRenamed("id", "raw_id")), F.col("received_at")).withColumn("id", F.col("raw_id"))

    def plan(v: Version) -> dict | None:
        if v.writers.get("landing", -1) >= number:
            return None
        status = judged.withColumnRenamed("id", "raw_id")
        add, remove, done = {}, {}, ods
        if work is not None:
            done, logs, later = retries.pass_over(m, v, ods, work, F.current_timestamp(), "raw_id")
            add = {n: m.write(n, df) for n, df in logs.items()} | {"retries": m.write("retries", later)}
            done, remove = done.drop("attempt"), {"retries": v.folders.get("retries", [])}
        orders = m.write("orders", done)
        events_ = m.write("quality_events", events.initial_events(spark.read.parquet(f"{root}/{orders[0]}")))
        add |= {"orders": orders, "quality_events": events_, "status": m.write("status", status)}
        return {"add": add, "remove": remove, "writer": "landing", "batch": number, "counts": {"records": sum(counts.values()), **counts}}

    m.transact(plan)


def work_again(spark: SparkSession, root: str, work: retries.Work, now=None) -> Version:
    """Another attempt for the landed orders that wait and are due, with a joint commit of what succeeds."""
    m = Manifest(spark, root)

    def plan(v: Version) -> dict:
        done, logs, later = retries.pass_over(m, v, None, work, F.current_timestamp() if now is None else now, "raw_id")
        orders = m.write("orders", done.drop("attempt"))
        add = {"orders": orders, "quality_events": m.write("quality_events", events.initial_events(spark.read.parquet(f"{root}/{orders[0]}"))), "retries": m.write("retries", later), **{n: m.write(n, df) for n, df in logs.items()}}
        return {"add": add, "remove": {"retries": v.folders["retries"]}, "writer": "again"}

    return m.transact(plan)


def land_stream(source: DataFrame, root: str, checkpoint: str, files_per_batch: int = 1000, work: retries.Work | None = None) -> StreamingQuery:
    """All documents there are, then stop. A first query reads the JSON once into ``bronze`` and ends before the second one
    starts, which judges the records of bronze and commits them; the second is returned, running. Orders seen before are kept in
    a RocksDB state store, offsets in ``checkpoint``."""
    spark, read = source.sparkSession, read_once(source)
    read.writeStream.format("parquet").option("compression", "zstd").option("path", f"{root}/bronze").option("checkpointLocation", f"{checkpoint}/bronze").trigger(availableNow=True).start().awaitTermination()
    rows = spark.readStream.schema(read.schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{root}/bronze")
    provider, before = "spark.sql.streaming.stateStore.providerClass", None
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        land = lambda df, n: land_batch(df, n, root, read.schema, work)
        return with_new_keys(rows).writeStream.queryName("landing").foreachBatch(land).option("checkpointLocation", f"{checkpoint}/landing").outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)


def landed(spark: SparkSession, root: str, table: str, version: Version | None = None) -> DataFrame:
    """A landed table (orders, quality_events, status), as of one version: the newest, or one shared by several reads."""
    return Manifest(spark, root).table(table, version)


def raw_records(spark: SparkSession, root: str) -> DataFrame:
    """(id, received_at, raw_payload) of every landed record."""
    rows = spark.read.parquet(f"{root}/bronze").select("received_at", "raw_payload", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return rows.join(one_a_key(landed(spark, root, "status").select(F.col("raw_id").alias("id"), "file", "row")), ["file", "row"]).select("id", "received_at", "raw_payload")


class LandingMetrics(StreamingQueryListener):
    """Of each micro-batch: seconds, input rows, and the rows and bytes of its state."""

    def __init__(self, name: str = "landing") -> None:
        self.name, self.batches = name, []

    def onQueryStarted(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name == self.name and p.stateOperators:
            self.batches.append({"batch": p.batchId, "seconds": p.batchDuration / 1000, "state_rows": sum(s.numRowsTotal for s in p.stateOperators), "state_bytes": sum(s.memoryUsedBytes for s in p.stateOperators)})


def commit_metrics(spark: SparkSession, root: str) -> DataFrame:
    """(writer, le, n, total, records, duplicates, errors, retries): how long each writer's commits took, in fixed buckets, and what
    they counted. The log has an entry a commit."""
    rows = [(h["writer"], float(h["seconds"] or 0), h["attempts"] - 1, *(h["counts"].get(k, 0) for k in ("records", "duplicate", "error"))) for h in Manifest(spark, root).history()]
    log = spark.createDataFrame(rows, "writer string, seconds double, retries bigint, records bigint, duplicates bigint, errors bigint")
    sums = log.groupBy("writer").agg(*[F.sum(c).alias(c) for c in ("records", "duplicates", "errors", "retries")])
    return distributions.histogram(log, ["writer"], "seconds").join(sums, "writer")


def replay(raw: DataFrame, status: DataFrame, ids: DataFrame | None = None, statuses: Iterable[str] = ()) -> DataFrame:
    """The raw records to process again: those with the ids (``id``), and those whose status is one of ``statuses``."""
    wanted = status.where(F.col("status").isin(*statuses)).select(F.col("raw_id").alias("id"))
    if ids is not None:
        wanted = wanted.unionByName(ids.select("id"))
    return raw.join(wanted.distinct(), "id", "left_semi")


def recovery_pages(raw: DataFrame, as_of, page: int = 5000, **limits: int) -> Iterator[DataFrame]:
    """Pages of records to work on again, by id (unique): each is a bounded piece of work. The table is read once: what waits is
    stored in order of ids, a record's page follows from its place there, and a page reads the row groups of its own ids. The
    driver sees two numbers a file and two a page."""
    todo = stored(waiting(raw, as_of, **limits).repartitionByRange("id").sortWithinPartitions("id"), "recovery")
    rows = todo.select("id", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    before, offsets = 0, []
    for file, n in sorted(tuple(r) for r in rows.groupBy("file").count().collect()):
        offsets.append((file, before))
        before += n
    if not before:
        return
    place = rows.join(F.broadcast(raw.sparkSession.createDataFrame(offsets, "file string, _before bigint")), "file")  # a row a file
    pages = place.groupBy(F.floor((F.col("_before") + F.col("row")) / page).alias("page")).agg(F.min("id").alias("low"), F.max("id").alias("high"))
    for r in pages.orderBy("page").collect():
        yield todo.where(F.col("id").between(r["low"], r["high"])).orderBy("id")


def over_limit(requests: DataFrame, client: str, at: str, limit: int, window: str = "1 minute") -> DataFrame:
    """Fixed windows in which a client made more requests than allowed. Works on tables and on streams (with a
    watermark, which bounds the state)."""
    if requests.isStreaming:
        requests = requests.withWatermark(at, "3 days")
    counts = requests.groupBy(F.col(client), F.window(at, window).alias("w")).agg(F.count(F.lit(1)).alias("requests"))
    return counts.where(F.col("requests") > limit).select(client, F.col("w.start").alias("window_start"), "requests", (F.col("requests") - limit).alias("refused"))


class Breaker:
    """The circuit breaker as a fold over calls in order. State: (failures so far, None) while closed, (-1, when) while
    open; times are microseconds."""

    def __init__(self, failures: int, wait: int) -> None:
        self.failures, self.wait = failures, wait

    def fold(self, t: list[int], ok: list[bool], bad: int, opened: int | None) -> list[str]:
        """The answer to each call, from a state on."""
        out = []
        for at, good in zip(t, ok, strict=True):
            if opened is not None and at - opened < self.wait:
                out.append("open")
                continue
            out.append("closed" if opened is None else "half_open")
            if good:
                bad, opened = 0, None
            elif opened is not None or bad + 1 >= self.failures:
                bad, opened = -1, at
            else:
                bad += 1
        return out

    def summary(self, t: np.ndarray, ok: list[bool]) -> tuple[list[tuple], list[int], list[tuple]]:
        """What some calls make of any state before them, without knowing it: the state after them for each number of
        failures while closed; and, if the first call let through is number j, for each j (calls whose answer is the same
        as the next's are left out): times and states. From the last call back, each state once."""
        later = np.searchsorted(t, t + self.wait, side="left").tolist()
        closed = [(b, None) for b in range(self.failures)]
        trial: list[tuple] = [()] * len(t)
        for j in range(len(t) - 1, -1, -1):
            opens = trial[later[j]] if later[j] < len(t) else (-1, int(t[j]))
            after = closed
            trial[j] = after[0] if ok[j] else opens
            closed = [after[0]] * self.failures if ok[j] else [*after[1:], opens]
        last = [j for j in range(len(t)) if j + 1 == len(t) or trial[j + 1] != trial[j]]
        return closed, [int(t[j]) for j in last], [trial[j] for j in last]

    def after(self, state: tuple, closed: list[tuple], times: list[int], trial: list[tuple]) -> tuple:
        """The state after some calls, by their summary."""
        bad, opened = state
        if opened is None:
            return closed[bad]
        j = int(np.searchsorted(times, opened + self.wait, side="left"))
        return trial[j] if j < len(times) else state


def breaker_states(calls: DataFrame, key: str = "service", at: str = "ts", ok: str = "ok", failures: int = 3, seconds: float = 30.0, width: float = 3600.0) -> DataFrame:
    """The circuit breaker's answer to each call: closed, open (refused) or half_open (one trial).

    A key's calls are one sequence, but no task folds all of it: the calls of each span of ``width`` seconds are
    summarised for any state before them, the summaries (a row a key and span) are chained, and each span is folded from
    the state that the chain gives it. A null in ``ok`` is a failure."""
    breaker, kinds = Breaker(failures, round(seconds * 1e6)), dict(calls.dtypes)
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast(kinds[at]), F.col(at))
    rows = calls.select(key, at, ok, micros.alias("_t")).withColumn("_span", F.floor(F.col("_t") / round(width * 1e6)))
    ordered = lambda pdf: pdf.assign(_ok=pdf[ok].fillna(False).astype(bool)).sort_values(["_t", "_ok"], kind="stable")

    def summarise(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = ordered(pdf)
        closed, times, trial = breaker.summary(pdf["_t"].to_numpy(), pdf["_ok"].tolist())
        pair = lambda states: ([[b for b, _ in states]], [[o for _, o in states]])
        (cb, co), (tb, to) = pair(closed), pair(trial)
        return pd.DataFrame({key: [group[0]], "_span": [group[1]], "closed_bad": cb, "closed_at": co, "times": [times], "trial_bad": tb, "trial_at": to})

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = (0, None), []
        pdf = pdf.sort_values("_span")
        none = lambda xs: [None if pd.isna(x) else int(x) for x in xs]
        for r in pdf.itertuples(index=False):
            out.append(state)
            state = breaker.after(state, list(zip(r.closed_bad, none(r.closed_at), strict=True)), list(r.times), list(zip(r.trial_bad, none(r.trial_at), strict=True)))
        return pd.DataFrame({key: pdf[key], "_span": pdf["_span"], "bad": [int(b) for b, _ in out], "opened": pd.array([o for _, o in out], dtype="Int64")})

    def refold(pdf: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        pdf = ordered(pdf)
        opened = entry["opened"].iloc[0]
        return pdf[[key, at, ok]].assign(state=breaker.fold(pdf["_t"].tolist(), pdf["_ok"].tolist(), int(entry["bad"].iloc[0]), None if pd.isna(opened) else int(opened)))

    lists = "closed_bad array<bigint>, closed_at array<bigint>, times array<bigint>, trial_bad array<bigint>, trial_at array<bigint>"
    summaries = rows.groupBy(key, "_span").applyInPandas(summarise, f"{key} {kinds[key]}, _span bigint, {lists}")
    entries = summaries.groupBy(key).applyInPandas(chain, f"{key} {kinds[key]}, _span bigint, bad bigint, opened bigint")
    return rows.groupBy(key, "_span").cogroup(entries.groupBy(key, "_span")).applyInPandas(refold, f"{key} {kinds[key]}, {at} {kinds[at]}, {ok} {kinds[ok]}, state string")

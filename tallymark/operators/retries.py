"""Attempts, back-off and dead letters for records whose work may fail.

The state is a table: records that failed for a passing reason, with their number of attempts and the instant from which they
may be tried again. A pass takes the new records and those that are due, and says of each: done, to be tried again, or dead.
What can never succeed (a terminal failure) is dead at once, what failed for a passing reason after ``TRIES`` attempts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.sources.manifest import Manifest, Version
from tallymark.sources.store import stored

#: Attempts in all; the pause after the n-th is BASE_SECONDS * 2^(n - 1).
TRIES, BASE_SECONDS = 3, 0.5
DONE, RETRY, DEAD = "done", "retry", "dead"

#: Work adds this column: null for success; ``passing`` says whether another attempt may succeed.
FAILURE = "struct<error_class:string,error_message:string,passing:boolean>"
Work = Callable[[DataFrame], DataFrame]


def failed(when: Column, error_class: str, message: str, passing: bool) -> Column:
    """A failure where the condition holds, else null."""
    return F.when(when, F.struct(F.lit(error_class).alias("error_class"), F.lit(message).alias("error_message"), F.lit(passing).alias("passing")))


def settle(worked: DataFrame, now: Column, tries: int = TRIES, base: float = BASE_SECONDS) -> DataFrame:
    """worked (with ``attempt``, from 1, and ``failure``) plus ``outcome``, and ``due_at`` of what is to be tried again."""
    again = F.col("failure.passing") & (F.col("attempt") < tries)
    outcome = F.when(F.col("failure").isNull(), DONE).when(F.coalesce(again, F.lit(False)), RETRY).otherwise(DEAD)
    pause = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.lit(base) * F.pow(F.lit(2.0), F.col("attempt") - 1)).cast("decimal(18,6)"))
    return worked.withColumn("outcome", outcome).withColumn("due_at", F.when(F.col("outcome") == RETRY, now.cast("timestamp") + pause))


def pass_over(m: Manifest, v: Version, records: DataFrame | None, work: Work, now: Column, key: str, **limits) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """One pass at version ``v``: the new records (None for none) and those due are worked on once. Returns what is done,
    the rows for the tables ``attempts`` and ``dead_letters``, and the new content of ``retries``. Every record is worked on once
    a pass and its outcome stored before it is used, so the tables agree even where the work itself would not."""
    waiting = m.table("retries", v) if v.folders.get("retries") else None
    todo = records.withColumn("attempt", F.lit(1)) if records is not None else None
    if waiting is not None:
        due = waiting.where(F.col("due_at") <= now.cast("timestamp")).withColumn("attempt", F.col("attempt") + 1).drop("due_at", "error_class", "error_message")
        todo = due if todo is None else todo.unionByName(due)
    if todo is None:
        raise ValueError("nothing to work on: no records were given and none wait")
    tried = stored(settle(work(todo), now, **limits), "tried")
    named = tried.select("*", "failure.error_class", "failure.error_message")
    log = named.select(key, "attempt", "outcome", "error_class", now.cast("timestamp").alias("tried_at"))
    dead = named.where(F.col("outcome") == DEAD).select(key, "attempt", "error_class", "error_message", now.cast("timestamp").alias("dead_at"))
    later = named.where(F.col("outcome") == RETRY).drop("outcome", "failure")
    if waiting is not None:
        later = later.unionByName(waiting.where(F.col("due_at") > now.cast("timestamp")))
    return tried.where(F.col("outcome") == DONE).drop("outcome", "failure", "due_at"), {"attempts": log, "dead_letters": dead}, later


def run_once(m: Manifest, records: DataFrame | None, work: Work, now: Column, key: str, table: str = "done", batch: int | None = None, writer: str = "worker", **limits) -> Version:
    """``pass_over`` and a joint commit of all its tables; a batch that was committed before is left out."""

    def plan(v: Version) -> dict | None:
        if batch is not None and v.writers.get(writer, -1) >= batch:
            return None
        done, logs, later = pass_over(m, v, records, work, now, key, **limits)
        add = {table: m.write(table, done), "retries": m.write("retries", later), **{n: m.write(n, df) for n, df in logs.items()}}
        return {"add": add, "remove": {"retries": v.folders.get("retries", [])}, "writer": writer, "batch": batch}

    return m.transact(plan)


def next_due(m: Manifest):
    """The earliest instant at which a record may be tried again; None if none waits."""
    v = m.version()
    return m.table("retries", v).agg(F.min("due_at")).first()[0] if v.folders.get("retries") else None


def attempts_by_class(m: Manifest) -> DataFrame:
    """How many records ended each attempt how, by error class (null for success)."""
    return m.table("attempts").groupBy("outcome", "error_class", "attempt").agg(F.count(F.lit(1)).alias("records"))

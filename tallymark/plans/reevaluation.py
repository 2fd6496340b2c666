"""Re-evaluation of quarantined orders by the rules as they are now: verdicts, planned events, counts, commit."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark import contracts as C
from tallymark.operators import events as E
from tallymark.operators import rules
from tallymark.sources.manifest import Manifest, Version
from tallymark.sources.store import stored


class WrongVersion(RuntimeError):
    """Events keep their rule version for good; the caller expected another one."""


class Plan(NamedTuple):
    events: DataFrame
    counts: DataFrame


def judge_again(candidates: DataFrame, **limits: int) -> DataFrame:
    """candidates with ``new_codes`` and ``new_message`` (null if clean), as of each order's own receipt: a rule on time
    must not turn with the clock. The first verdict stays in ``clean_error_message``."""
    own = [F.col(c) for c in candidates.columns]
    again = rules.evaluate(candidates.withColumn("_first", F.col("clean_error_message")), F.col("received_at"), **limits)
    again = again.withColumns({"new_message": F.col("clean_error_message"), "new_codes": rules.codes(F.col("clean_error_message")), "clean_error_message": F.col("_first"), "has_clean_error": F.lit(True)})
    return again.select(*own, "new_codes", "new_message")


def plan(orders: DataFrame, log: DataFrame, event_at: Column, limit: int | None = None, expect_version: str | None = None, **limits: int) -> Plan:
    """What a re-evaluation would write, and its counts; nothing is written. All events share ``event_at``."""
    if expect_version not in (None, C.RULE_VERSION):
        raise WrongVersion(f"the rules are {C.RULE_VERSION}, not {expect_version}")
    judged = judge_again(E.candidates(E.with_effective_state(orders, log), limit), **limits)
    judged = stored(judged.select("raw_id", "order_id", "clean_error_message", "event_state", "new_codes", "new_message"), "judged-again")
    events = E.plan_events(judged, event_at, reason="new_message")
    return Plan(events, E.plan_counts(judged, events))


def commit(planned: Plan, path: str) -> int:
    """Appends the planned events to the log at ``path``, all or none (one job, one commit of its files); how many. Their
    ids continue the log's own by hash, so a run that is repeated after a failure plans against what the log then says."""
    rows = planned.events.withColumn("id", F.xxhash64("raw_id", "event_at", "to_state")).select("id", *planned.events.columns)
    rows = stored(rows, "planned-events")
    n = rows.count()
    if n:
        rows.write.mode("append").parquet(path)
    return n


def reevaluate(orders: DataFrame, log: DataFrame, path: str, event_at: Column, dry_run: bool = True, limit: int | None = None, expect_version: str | None = None, **limits: int) -> Plan:
    """``plan``, and ``commit`` only if dry_run is turned off: the log is append-only, what is wrong in it stays."""
    planned = plan(orders, log, event_at, limit, expect_version, **limits)
    if not dry_run:
        commit(planned, path)
    return planned


def reevaluate_landed(spark: SparkSession, root: str, event_at: Column, limit: int | None = None, expect_version: str | None = None, **limits: int) -> Version:
    """Re-evaluates the orders landed in the manifest at ``root`` and commits the events to its log. What is planned holds for one
    version of orders and log alone: if anything else was committed since, it is planned anew. No events, no commit."""
    m = Manifest(spark, root)

    def work(v: Version) -> dict | None:
        planned = plan(m.table("orders", v), m.table("quality_events", v), event_at, limit, expect_version, **limits)
        counts = planned.counts.first().asDict()
        if not counts["promoted"] + counts["re_quarantined"]:
            return None
        rows = planned.events.withColumn("id", F.xxhash64("raw_id", "event_at", "to_state"))
        like = m.table("quality_events", v).schema.names
        return {"add": {"quality_events": m.write("quality_events", rows.select(*like))}, "writer": "reevaluation", "counts": counts}

    return m.transact(work)

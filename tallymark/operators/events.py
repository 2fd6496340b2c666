"""The quality event log and the states derived from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark import contracts as C
from tallymark.operators.rules import codes
from tallymark.sources.store import one_a_key


def initial_events(ods: DataFrame) -> DataFrame:
    """One event for each landed order: clean or quarantined, at the order's own landing instant."""
    return ods.select(
        F.col("raw_id").alias("id"),
        "raw_id",
        "order_id",
        F.lit("initial_evaluation").alias("event_type"),
        F.lit(None).cast("string").alias("from_state"),
        F.when(F.col("has_clean_error"), C.QUARANTINED).otherwise(C.CLEAN).alias("to_state"),
        F.col("dq_rule_version").alias("rule_version"),
        F.col("received_at").alias("event_at"),
        F.col("clean_error_message").alias("reason"),
    )


def latest_event(events: DataFrame, key: str = "raw_id", at: str = "event_at", tie: str = "id") -> DataFrame:
    """The last event of each key by (at, tie). Spark keeps the first row of each key on the map side already (a window
    group limit), so a key with a long history sends one row of each task."""
    return keep_latest(events, key, F.desc(at), F.desc(tie))


def with_effective_state(orders: DataFrame, events: DataFrame, key: str = "raw_id") -> DataFrame:
    """orders with ``effective_quality_state``, ``quality_state_at`` and ``event_state`` (what the last event says, null if
    there is none); never a null effective state, never a lost order."""
    last = latest_event(events, key).select(key, F.col("to_state").alias("event_state"), F.col("event_at").alias("quality_state_at"))
    df = orders.join(one_a_key(last), key, "left")
    fine = F.coalesce(~F.col("has_clean_error") | (F.col("event_state") == C.PROMOTED), F.lit(False))
    state = (
        F.when(F.coalesce(~F.col("has_clean_error"), F.lit(False)), C.CLEAN)
        .when(F.col("event_state") == C.PROMOTED, C.PROMOTED)
        .when(F.col("event_state") == C.REJECTED, C.REJECTED)
        .otherwise(C.QUARANTINED)
    )
    return df.withColumn("is_effectively_clean", fine).withColumn("effective_quality_state", state)


def clean_side(states: DataFrame) -> DataFrame:
    return states.where("is_effectively_clean").drop("is_effectively_clean")


def quarantine_side(states: DataFrame) -> DataFrame:
    since = F.coalesce("quality_state_at", "received_at").alias("quarantined_at")
    return states.where("not is_effectively_clean").select("*", since).drop("is_effectively_clean")


def target_state(current: Column, original_codes: Column, passes: Column) -> Column:
    """The state to move to, or null for no event. A human's final rejection stands; a pass that only comes from a
    value having been cleared is none."""
    blocked = F.arrays_overlap(original_codes, F.array(*[F.lit(c) for c in C.NON_REPRODUCIBLE]))
    target = F.when(passes & ~F.coalesce(blocked, F.lit(False)), C.PROMOTED).when(current == C.PROMOTED, C.RE_QUARANTINED)
    return F.when(~current.eqNullSafe(F.lit(C.REJECTED)) & ~target.eqNullSafe(current), target)


def candidates(states: DataFrame, limit: int | None = None) -> DataFrame:
    """Dirty orders of either side that no human has rejected; with a limit, the first by raw_id."""
    dirty = states.where(F.col("has_clean_error") & (F.col("effective_quality_state") != C.REJECTED))
    return dirty.orderBy("raw_id").limit(limit) if limit else dirty


def plan_events(candidates: DataFrame, event_at: Column, new_codes: str = "new_codes", version: str = C.RULE_VERSION, reason: str | None = None) -> DataFrame:
    """Events of a re-evaluation: only changes, all at ``event_at``. ``new_codes`` holds what the rules find now,
    ``event_state`` what the event log said last; so a second run plans nothing."""
    passes = F.size(F.coalesce(F.col(new_codes), F.array().cast("array<string>"))) == 0
    df = candidates.withColumn("from_state", F.col("event_state"))
    df = df.withColumn("to_state", target_state(F.col("from_state"), codes(F.col("clean_error_message")), passes)).where("to_state is not null")
    kind = F.when(F.col("to_state") == C.PROMOTED, "re_evaluation").otherwise("re_quarantination")
    why = F.when(F.size(new_codes) > 0, F.col(reason or new_codes))
    return df.select("raw_id", "order_id", kind.alias("event_type"), "from_state", "to_state", F.lit(version).alias("rule_version"), event_at.alias("event_at"), why.alias("reason"))


def plan_counts(candidates: DataFrame, planned: DataFrame) -> DataFrame:
    """One row: candidates, promoted, re_quarantined, unchanged, blocked_non_reproducible."""
    bad = F.arrays_overlap(codes(F.col("clean_error_message")), F.array(*[F.lit(c) for c in C.NON_REPRODUCIBLE]))
    a = candidates.agg(F.count(F.lit(1)).alias("candidates"), F.count_if(bad).alias("blocked_non_reproducible"))
    b = planned.agg(F.count_if(F.col("to_state") == C.PROMOTED).alias("promoted"), F.count_if(F.col("to_state") == C.RE_QUARANTINED).alias("re_quarantined"))
    return a.crossJoin(b).withColumn("unchanged", F.col("candidates") - F.col("promoted") - F.col("re_quarantined"))  # one row each


def first_write(arrivals: DataFrame, key: str, order: list[str], existing: DataFrame | None = None) -> DataFrame:
    """arrivals with ``status``: the first of each key is processed, later ones and known keys are duplicates."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    df = arrivals.withColumn("_nth", nth)
    if existing is None:
        return df.withColumn("status", F.when(F.col("_nth") == 1, "processed").otherwise("duplicate")).drop("_nth")
    known = existing.select(key).distinct().withColumn("_known", F.lit(True))
    df = df.join(known, key, "left")
    return df.withColumn("status", F.when((F.col("_nth") == 1) & F.col("_known").isNull(), "processed").otherwise("duplicate")).drop("_nth", "_known")


def keep_latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row a key, the first by ``order`` (made total by the caller)."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_nth = 1").drop("_nth")

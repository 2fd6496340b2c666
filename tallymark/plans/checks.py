"""Data tests. Each returns the rows that break it; none means that it holds."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark import contracts as C


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def unique(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).count().where("count > 1")


def accepted(df: DataFrame, column: str, values: Iterable[str]) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*values))


def at_least(df: DataFrame, column: str, low: float) -> DataFrame:
    return df.where(F.col(column) < low)


def holds(df: DataFrame, rule: str | Column) -> DataFrame:
    """Rows where the rule is not true (null counts as broken)."""
    return df.where(~F.coalesce(F.expr(rule) if isinstance(rule, str) else rule, F.lit(False)))


def foreign_key(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Values of the child that the parent lacks; null ones are no violation."""
    keys = parent.select(F.col(parent_column).alias("_key")).distinct()
    return child.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_key"), "left_anti")


def split_is_partition(whole: DataFrame, clean: DataFrame, quarantine: DataFrame, key: str = "raw_id") -> DataFrame:
    """Keys that do not appear exactly once on the two sides together, or that no order has."""
    sides = clean.select(key).unionAll(quarantine.select(key)).groupBy(key).agg(F.count(F.lit(1)).alias("appearances"))
    mine = whole.select(F.col(key).alias("_own"))
    return mine.join(sides, F.col("_own") == F.col(key), "full").where(F.col("_own").isNull() | ~F.col("appearances").eqNullSafe(F.lit(1))).select(F.coalesce("_own", key).alias(key), "appearances")


def no_unpromoted_dirty(clean: DataFrame) -> DataFrame:
    return clean.where(F.col("has_clean_error") & (F.col("effective_quality_state") != C.PROMOTED))


def state_resolved(states: DataFrame, as_of: Column, low: int = 2, high: int = 50) -> DataFrame:
    """Orders of that age in days without any event."""
    age = F.datediff(F.to_date(as_of), F.to_date("received_at"))
    return states.where(F.col("quality_state_at").isNull() & age.between(low, high))


def initial_event_time(orders: DataFrame, events: DataFrame) -> DataFrame:
    first = events.where("event_type = 'initial_evaluation'").select("raw_id", "event_at")
    off = F.timestamp_diff("MICROSECOND", F.col("received_at"), F.col("event_at"))
    return orders.select("raw_id", "received_at").join(first, "raw_id").withColumn("off_microseconds", off).where("off_microseconds <> 0")


def complete_projection(source: DataFrame, target: DataFrame, key: str = "order_id") -> DataFrame:
    return source.select(key).subtract(target.select(key))


def rollup_matches(orders: DataFrame, rollup: DataFrame, key: str, counters: Iterable[str], sums: Iterable[str]) -> DataFrame:
    """Orders whose measures differ from their items', null-safe and exact."""
    r = rollup.select(key, *[F.col(c).alias(f"_{c}") for c in (*counters, *sums)])
    df = orders.join(r, key, "full")
    off = [~F.col(c).eqNullSafe(F.coalesce(F.col(f"_{c}"), F.lit(0))) for c in counters] + [~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in sums]
    out = off[0]
    for x in off[1:]:
        out = out | x
    return df.where(out).select(key)


def attributes_stable(items: DataFrame, key: str, attributes: Iterable[str]) -> DataFrame:
    """Keys with more than one value of an attribute, and how many of each. Least and greatest value say which keys these
    are, in one aggregate that is merged in tasks; distinct values are counted for these keys alone, an attribute at a time."""
    names = list(attributes)
    named = items.where(F.col(key).isNotNull())
    ends = named.groupBy(key).agg(*[f(a).alias(f"{n}_{i}") for i, a in enumerate(names) for n, f in (("least", F.min), ("most", F.max))])
    differ = [F.coalesce(F.col(f"least_{i}") < F.col(f"most_{i}"), F.lit(False)) for i in range(len(names))]
    out = ends.where(F.array_contains(F.array(*differ), True)).select(key, *[d.alias(a) for d, a in zip(differ, names, strict=True)], *[F.col(f"most_{i}").isNotNull().cast("bigint").alias(f"_one_{i}") for i in range(len(names))])
    for i, a in enumerate(names):
        many = named.join(out.where(F.col(a)).select(key), key, "left_semi").select(key, F.col(a).alias("_value")).where("_value is not null").distinct()
        out = out.join(many.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), key, "left").withColumn(a, F.coalesce("_n", f"_one_{i}")).drop("_n", f"_one_{i}")
    return out.select(key, *names)


def no_item_loss(report: DataFrame, items: DataFrame, day: str = "order_date") -> DataFrame:
    a = report.groupBy(day).agg(F.sum("items").alias("reported"))
    b = items.groupBy(F.col(day).alias("_day")).agg(F.count(F.lit(1)).alias("rows"))
    return a.join(b, F.col(day).eqNullSafe(F.col("_day")), "full").where(~F.col("reported").eqNullSafe(F.col("rows")))


def events_split(report: DataFrame) -> DataFrame:
    return report.where("initial_clean + initial_quarantined <> initial_evaluations")


def backlog_balances(report: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Groups whose primary counts do not add up to the quarantined orders."""
    a = report.groupBy("quarantined_date", "rule_version", "state").agg(F.sum("orders_primary_code").alias("primary"))
    b = quarantine.groupBy(F.to_date("quarantined_at").alias("_d"), F.col("dq_rule_version").alias("_v"), F.col("effective_quality_state").alias("_s")).agg(F.count(F.lit(1)).alias("orders"))
    on = F.col("quarantined_date").eqNullSafe(F.col("_d")) & F.col("rule_version").eqNullSafe(F.col("_v")) & F.col("state").eqNullSafe(F.col("_s"))
    return a.join(b, on, "full").where(~F.col("primary").eqNullSafe(F.col("orders")))
